"""Training-data operators: language ID, deduplication, packing, extraction, tokenising.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
