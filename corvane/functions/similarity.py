"""Similarities that Spark has no built-in for, over Arrow batches."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import collapse


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def sequence_similarity(a: Column, b: Column) -> Column:
    """Twice the matched characters over both lengths, of the texts in lower case and with single blanks."""
    return F.pandas_udf(_ratio, "double")(F.lower(collapse(a)), F.lower(collapse(b)))


def _highest(one: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else max((difflib.SequenceMatcher(None, x, y).ratio() for y in (ys if ys is not None else ()) if y is not None), default=0.0) for x, ys in zip(one, others)], dtype="float64")


def highest_similarity(c: Column, others: Column) -> Column:
    """The highest sequence_similarity to any of an array of texts; 0 with none.  Null elements are
    like nothing; for a null text it is null."""
    return F.pandas_udf(_highest, "double")(F.lower(collapse(c)), F.transform(others, lambda x: F.lower(collapse(x))))
