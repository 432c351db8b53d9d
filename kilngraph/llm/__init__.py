"""Training-data pipeline operators: deduplication, scoring, scanning, packing and mixing.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and ``__spark_entry__.py`` are its only callers.
"""
