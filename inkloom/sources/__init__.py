"""Sources of the review analytics library."""
