"""operators of the analytics library."""
