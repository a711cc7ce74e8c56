"""plans of the feature analytics."""
