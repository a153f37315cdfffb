"""Plans of the review analytics library."""
