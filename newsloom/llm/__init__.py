"""Corpus-preparation operators for training-data pipelines.

Self-contained: nothing else in the library imports this package.
"""
