"""Training-data operators: deduplication, tokenising, search, filtering and scoring of text tables."""
