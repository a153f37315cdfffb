"""Streaming of the review analytics library."""
