"""Operators for building training data from large document tables.

Nothing outside this folder imports it (``__spark_entry__.py`` does so behind
a guard, ``corpus_pipeline.py`` is part of it).
"""
