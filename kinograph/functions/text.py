"""Text folding. Only Unicode decomposition and sequence similarity leave the JVM."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"


def _decomposed(s: pd.Series) -> pd.Series:
    import unicodedata

    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return s.map(fold)


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return _decomposed(s)


@F.pandas_udf(T.StringType())
def fold_case(s: pd.Series) -> pd.Series:
    return _decomposed(s).str.casefold()


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings, 0..1."""
    memo: dict = {}

    def one(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in memo:
            memo[x, y] = SequenceMatcher(None, x, y).ratio()
        return memo[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def _words(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(c, _NOT_WORD, " "), r"(?U)\s+", " "))


def normalise_title(c: Column) -> Column:
    """Search form of a title: no accents, case, punctuation or one leading article."""
    return F.regexp_replace(_words(F.lower(fold_accents(c))), r"^(the|a|an) ", "")


def normalise_export_title(c: Column) -> Column:
    """Import form: apostrophes vanish, articles stay."""
    return _words(F.regexp_replace(fold_case(c), "['‘’ʼ´`]", ""))


def normalise_label(c: Column) -> Column:
    """ASCII form for file labels."""
    ascii_only = F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")
    amp = F.regexp_replace(F.lower(ascii_only), "&", " and ")
    return F.btrim(F.regexp_replace(F.regexp_replace(amp, r"^(the|a|an)\s+", ""), "[^a-z0-9]+", " "))


def search_key(c: Column) -> Column:
    """Exact-tier key: everything but ASCII letters, digits and spaces becomes a space."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9 ]", " "))
