"""Column functions shared by the operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: What counts as white space at the ends of a text.
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column | str, side: str = "both") -> Column:
    """``text`` without the characters of WHITE at its ends, or at its left or right end alone."""
    return {"both": F.trim, "left": F.ltrim, "right": F.rtrim}[side](F.col(text) if isinstance(text, str) else text, F.lit(WHITE))


def half_up(x: Column, digits: int) -> Column:
    """Rounds halves toward positive infinity, as a double."""
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def identity(text: Column) -> Column:
    """White space runs become one space, ends are trimmed, letters lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def dedup_key(text: Column) -> Column:
    """White space runs become one space, ends are trimmed, then the first 120 characters in lower case."""
    return F.lower(F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 120))


def _nfc(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    """NFC of each text, a batch at a time."""
    return text.map(_nfc)


def fold(text: Column) -> Column:
    """Letters are composed (NFC), ends are trimmed, and what is left is lower-cased; null stays null."""
    return F.lower(trimmed(_composed(text)))


@F.pandas_udf(ArrayType(StringType()))
def _composed_all(texts: pd.Series) -> pd.Series:
    """NFC of each text of arrays, a batch at a time."""
    return texts.map(lambda x: None if x is None else [_nfc(t) for t in x])


def fold_all(texts: Column) -> Column:
    """``fold`` of every text of an array; null texts stay null."""
    return F.transform(_composed_all(texts), lambda t: F.lower(trimmed(t)))


def blob_sha(content: Column) -> Column:
    """Content address of a blob: SHA-1 over a header with its length, and its bytes."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(b"\0"), content.cast("binary")))


def query_tokens(query: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits."""
    import re

    return [t for t in re.split(r"[^a-z0-9]+", query.lower()) if t]


def trigrams(lower: Column) -> Column:
    """Distinct substrings of three characters; empty where the text is shorter."""
    n = F.char_length(lower)
    starts = F.when(n >= 3, F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: lower.substr(i, F.lit(3))))
