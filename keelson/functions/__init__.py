"""functions of the retention library."""
