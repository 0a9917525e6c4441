"""HTML entities and percent decoding, which Spark has no equal of, as Arrow UDFs; percent encoding and lenient decoding of built-in functions."""

from __future__ import annotations

import html
import urllib.parse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """HTML5 entities, also those without a semicolon."""
    return s.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


@F.pandas_udf(StringType())
def url_unquote(s: pd.Series) -> pd.Series:
    """Percent decoding that leaves plus signs and broken sequences alone."""
    return s.map(lambda x: urllib.parse.unquote(x) if x is not None and "%" in x else x)


def url_quote(s: Column | str) -> Column:
    """Percent encoding of a path, slashes kept."""
    form = F.url_encode(s)  # of a form: a plus is a space, a tilde coded and a star not
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        form = F.replace(form, F.lit(old), F.lit(new))
    return form


def decode_lenient(data: Column | str) -> Column:
    """UTF-8 without the bytes that are none: they become U+FFFD and go, while those that the text itself holds are kept under a mark."""
    bad, mark, own = F.lit("\ufffd"), F.lit("\0"), F.lit("\0b")
    text = (F.col(data) if isinstance(data, str) else data).cast("string")
    marked = F.replace(F.replace(text, mark, F.lit("\0a")), bad, own)
    return F.replace(F.replace(F.replace(F.make_valid_utf8(marked), bad, F.lit("")), own, bad), F.lit("\0a"), mark)
