"""functions of the feature analytics."""
