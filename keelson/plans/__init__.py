"""plans of the retention library."""

from . import decisions, histories, measures, profiles, queries, stores  # noqa: F401  (the others register their queries with these)
