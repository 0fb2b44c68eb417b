"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_tokens(col: Column | str, separator: str = "|") -> Column:
    """Array of the parts of a joined string; ``separator`` is literal text.

    Empty parts are kept. A null string gives a null array.
    """
    return F.split(col, re.escape(separator))


def suffix_window(col: Column | str, from_end: int, length: int) -> Column:
    """``length`` characters starting ``from_end`` characters before the end.

    Text shorter than ``from_end`` is clipped, not padded, and trailing blanks
    count as characters.
    """
    return F.substring(col, -from_end, length)


def title_year(col: Column | str) -> Column:
    """Year in a closing ``(YYYY)``, trailing blanks allowed; null without one."""
    return F.nullif(F.regexp_extract(col, r"\((\d{4})\)\s*$", 1), F.lit(""))
