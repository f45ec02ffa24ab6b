"""Spellings of authors, post ids and terms brought to one form, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_EDGE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without surrounding blanks of any kind."""
    return F.regexp_replace(c, _EDGE, "")


def contributor(author: Column) -> Column:
    """Lower case, no surrounding blanks, no leading u/ or /u/; null for null, blank and deleted authors."""
    name = F.regexp_replace(trimmed(F.lower(author)), "^/?u/", "")
    return F.when((name == "") | (name == "[deleted]"), None).otherwise(name)


def post_id(raw: Column) -> Column:
    """'t3_' plus the id in lower case; null for null and blank."""
    bare = F.regexp_replace(trimmed(F.lower(raw)), "^t3_", "")
    return F.when(bare == "", None).otherwise(F.concat(F.lit("t3_"), bare))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def term(raw: Column) -> Column:
    """Lower case, composed, single spaces for white space, hyphens and underscores; null for null and blank."""
    spaced = F.regexp_replace(F.lower(_nfc(raw)), r"(?U)[\s_\-‐‑]+", " ")
    text = F.trim(_nfc(spaced))
    return F.when(text == "", None).otherwise(text)
