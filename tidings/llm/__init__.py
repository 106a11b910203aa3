"""Corpus operators for training-data pipelines.

Nothing else in the library imports this subpackage. ``queries.py`` lists its
registered queries; ``corpus_pipeline.py`` at the repository top chains five of
the operators.
"""
