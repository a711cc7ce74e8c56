"""operators of the feature analytics."""
