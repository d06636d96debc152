"""readloom: short-read sequence analytics and text-corpus operators as Spark DataFrame plans."""
