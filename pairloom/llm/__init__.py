"""Operators for training-data corpora.

Self-contained: nothing else in the library imports this subpackage, and it can be deleted
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
