"""Operators for preparing large training corpora, each usable on its own.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
