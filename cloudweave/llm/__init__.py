"""Operators for training-data pipelines over tables of documents and vectors.

Nothing outside this folder and ``corpus_pipeline.py`` imports it.
"""
