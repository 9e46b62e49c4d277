"""operators of the retention library."""
