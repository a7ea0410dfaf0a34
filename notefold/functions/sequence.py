"""The one primitive of text comparison that Spark has no expression for: aligning two sequences.

Python's sequence matcher defines the values (order of arguments and its junk rule
for long sequences included). Each pair is aligned once; everything else about a
comparison is Column expressions over what the alignment gives.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIGNMENT = T.StructType([T.StructField("matched", T.IntegerType()), T.StructField("changed", T.ArrayType(T.StringType()))])


@F.pandas_udf(ALIGNMENT)
def _alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    matched, changed = [], []
    for x, y in zip(a, b):
        x, y = x or "", y or ""
        if x == y:
            matched.append(len(x))
            changed.append([])
            continue
        steps = SequenceMatcher(None, x, y).get_opcodes()
        matched.append(sum(j - i for tag, i, j, _, _ in steps if tag == "equal"))
        changed.append([x[i:j] + y[k:m] for tag, i, j, k, m in steps if tag != "equal"])
    return pd.DataFrame({"matched": pd.Series(matched, dtype="int32"), "changed": pd.Series(changed, dtype=object)})


@F.pandas_udf(T.IntegerType())
def matched_items(a: pd.Series, b: pd.Series) -> pd.Series:
    """Items of two lists that align; a null list is empty."""
    items = lambda v: [] if v is None else list(v)
    count = lambda x, y: len(x) if x == y else sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks())
    return pd.Series([count(items(x), items(y)) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def best_likeness(line: pd.Series, others: pd.Series) -> pd.Series:
    """Greatest likeness of a line to any of several; 0 where there is none, and for a null line, which is not compared."""
    best = lambda x, ys: 0.0 if x is None or ys is None else 1.0 if x in ys else max((SequenceMatcher(None, x, y).ratio() for y in ys), default=0.0)
    return pd.Series([best(x, None if ys is None else list(ys)) for x, ys in zip(line, others)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else s.casefold())


def alignment(a: Column, b: Column) -> Column:
    """Struct (matched characters, changed: the text of both sides at each place where they differ).

    A Python function is evaluated for every row, whatever condition stands around it,
    so equal texts are passed over inside it.
    """
    return _alignment(a, b)


def likeness(matched: Column, a: Column, b: Column) -> Column:
    """Twice the aligned characters by the characters of both sides; 1 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * matched / total)


def exclusive(matched: Column, a: Column, b: Column) -> Column:
    """Characters of either side that do not align."""
    return F.length(a) + F.length(b) - 2 * matched
