"""DataFrame operators of the panel engine."""
