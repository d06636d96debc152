"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm.decontaminate import OP4_SQL, op4_decontaminate
from readloom.llm.fillmiddle import OP12_SQL, op12_fill_middle
from readloom.llm.importance import OP11_SQL, op11_resample
from readloom.llm.license import OP6_SQL, op6_licenses
from readloom.llm.linededup import OP7_SQL, op7_line_dedup
from readloom.llm.neighbours import op3_neighbours
from readloom.llm.packing import op13_packing
from readloom.llm.pii import op8_pii
from readloom.llm.pieces import op2_sentencepiece
from readloom.llm.quality import op5_quality
from readloom.llm.repeats import op1_repeats
from readloom.llm.simhash import op10_simhash
from readloom.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_neighbours": op3_neighbours,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_resample": op11_resample,
    "op12_fill_middle": op12_fill_middle,
    "op13_packing": op13_packing,
}

SQL: dict[str, str] = {
    "op4_decontaminate": OP4_SQL,
    "op6_licenses": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_resample": OP11_SQL,
    "op12_fill_middle": OP12_SQL,
}
