"""Operators of a training-data pipeline: dedup, packing, scoring, extraction, search and formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
``queries.QUERIES`` holds one registered query per operator.
"""
