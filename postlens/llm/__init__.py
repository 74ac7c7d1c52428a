"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and ``corpus_pipeline.py`` chains five of the operators.
"""
