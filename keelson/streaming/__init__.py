"""streaming of the retention library."""
