"""Functions of the review analytics library."""
