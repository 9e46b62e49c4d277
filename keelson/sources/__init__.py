"""sources of the retention library."""
