"""Unicode normal forms: Spark has no built-in for them, so these are the only scalar functions in Python.

Only texts that a form could change are sent to Python; the rest stay in the JVM, and what is sent of them is a null.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _form(name: str, text: Column, changeable: str) -> Column:
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: unicodedata.normalize(name, x), na_action="ignore")

    sent = F.when(F.regexp_like(text, F.lit(changeable)), text)
    return F.coalesce(F.pandas_udf(normal, T.StringType())(sent), text)


def nfc(text: Column) -> Column:
    """Every character below U+0300 is its own NFC."""
    return _form("NFC", text, r"[^\x00-\u02ff]")


def nfkc(text: Column) -> Column:
    return _form("NFKC", text, r"[^\x00-\x7f]")
