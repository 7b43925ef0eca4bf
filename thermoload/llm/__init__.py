"""Training-data operators: quality rules, scoring, mixing, deduplication, packing, archives.

Nothing outside this subpackage, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
