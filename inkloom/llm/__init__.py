"""Operators for building training data from web-scale text.

Nothing outside this subpackage imports it; ``queries`` lists the contract
queries and ``corpus_pipeline.py`` chains five of the operators.
"""
