"""Relations that the operators read."""
