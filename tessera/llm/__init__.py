"""Operators of a training-data pipeline: tokenising, scoring, packing, deduplication, personal
data, fingerprints, chat formatting and nearest neighbours.  Nothing outside this package and
``corpus_pipeline.py`` imports it."""
