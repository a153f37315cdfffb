"""Operators of the review analytics library."""
