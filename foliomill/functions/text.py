"""Text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode defines it, and the four information separators.
_BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (no-break and ideographic spaces too; not BOM or zero-width space)."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def newlines(text: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")
