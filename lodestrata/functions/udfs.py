"""Arrow-batched functions for what Spark's built-ins cannot express."""

from __future__ import annotations

import difflib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.html import html_to_text as _html
from lodestrata.functions.jsonschema import Schema


@F.pandas_udf(T.StringType())
def html_to_text(raw: pd.Series) -> pd.Series:
    """Readable text of entity-escaped HTML; null gives ''."""
    return raw.map(lambda t: _html(t if isinstance(t, str) else None))


@F.pandas_udf(T.StringType())
def page_to_text(raw: pd.Series) -> pd.Series:
    """Readable text of plain HTML; null gives ''."""
    return raw.map(lambda t: _html(t if isinstance(t, str) else None, escaped=False))


def normal_form(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()


@F.pandas_udf(T.StringType())
def norm_key(text: pd.Series) -> pd.Series:
    """NFKC, full case folding, white space collapsed; null stays null."""
    return text.map(lambda t: normal_form(t) if isinstance(t, str) else None)


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts (null: empty). Quadratic: for pairs that were blocked before."""
    pairs = zip(a.fillna(""), b.fillna(""), strict=True)
    return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs], dtype="float64")


def schema_errors_udf(schema: dict):
    """A function of a JSON column that gives the array of its schema errors."""
    text = json.dumps(schema)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def errors(document: pd.Series) -> pd.Series:
        compiled = Schema(json.loads(text))
        return document.map(lambda d: compiled.errors_of_text(d if isinstance(d, str) else None))

    return errors


@F.udtf(returnType=T.StructType([T.StructField("position", T.IntegerType())]))
class Occurrences:
    """Table function: zero-based starts of a needle in a text, overlapping or not; none for null or empty."""

    def eval(self, text: str, needle: str, overlapping: bool):
        if not text or not needle:
            return
        at = text.find(needle)
        while at >= 0:
            yield (at,)
            at = text.find(needle, at + (1 if overlapping else len(needle)))


def register(spark) -> None:
    """Make the functions available to SQL under their names."""
    for f, name in ((html_to_text, "html_to_text"), (page_to_text, "page_to_text"), (norm_key, "norm_key"), (seq_ratio, "seq_ratio")):
        spark.udf.register(name, f)
    spark.udtf.register("occurrences", Occurrences)
