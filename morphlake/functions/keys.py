"""Keys under which rows count as the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that the edges of a word or identifier lose.
BLANKS = "[\\s\\u00A0\\u2000-\\u200A\\u202F\\u3000]+"


def trimmed(c: Column | str) -> Column:
    """c without blanks at its edges."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, f"^{BLANKS}|{BLANKS}$", "")


def word_key(c: Column | str) -> Column:
    """c without blanks at its edges, in lower case; null for null and for what is then empty."""
    key = F.lower(trimmed(c))
    return F.when(key != "", key)
