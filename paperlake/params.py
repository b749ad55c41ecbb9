"""Argument rules shared by the operators."""

# The defaults of arguments.
SEARCH_LIMIT = 20
SIMILAR_LIMIT = 10
RECENT_DAYS = 7
RECENT_LIMIT = 50
QUEUE_LIMIT = 500
EMBED_BATCH = 50
EMBED_DIM = 1536

# The categories mirrored by default.
DEFAULT_CATEGORIES = ["cs.AI", "cs.CL", "cs.LG", "cs.SE", "cs.CV", "stat.ML"]


def positive(value, default):
    """`value` as a positive int; anything missing, malformed or not positive gives `default`."""
    try:
        number = int(value)
    except (TypeError, ValueError):
        return default
    return number if number > 0 else default


def categories(value=None):
    """Split a comma-separated category list, or give the default six."""
    if not value:
        return list(DEFAULT_CATEGORIES)
    return [part.strip() for part in value.split(",")]
