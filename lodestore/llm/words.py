"""Words of whole texts: A-Z lower-cased, runs of ASCII letters, digits and all characters beyond ASCII."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: what stands between words, as Java reads it
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: Column | str) -> Column:
    """The words of a text in order; null and empty texts have none."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(low, BETWEEN), "")


def plain_words(text: str | None) -> list[bytes]:
    """The same words in a Python task, as UTF-8 (``bytes.lower`` changes A-Z only)."""
    return _WORD.findall((text or "").encode().lower())


#: the same list of words in DuckDB
SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
