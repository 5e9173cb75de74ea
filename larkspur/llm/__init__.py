"""Operators for preparing training data for language models.

Nothing outside this package, ``corpus_pipeline.py`` and their tests imports it.
"""
