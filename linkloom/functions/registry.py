"""Functions for queries written in SQL: register(spark) makes them known to spark.sql.

extract_urls is a table function, for use with LATERAL; the others are scalar functions over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from linkloom.functions import lexicon as lex
from linkloom.operators.rows import standing

WRITTEN = re.compile(r"(?:https?|ftp)://[^\s<>\[\]()\"']+|(?<![@\w./-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}(?::\d{2,5})?(?:/[^\s<>\[\]()\"']*)?", re.IGNORECASE)
MARKS = ".,;:!?)]}>\"'"


class ExtractUrls:
    """extract_urls(text [, tlds => 'one two']): ord, url, host, start of the addresses in a text, as they are written.

    A host needs a known top-level domain, or one of tlds. Blanks inside a link and words glued to its end are not
    repaired; that is what the DataFrame functions are for. A null text has none.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, tlds: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("extract_urls takes a text")
        if tlds is not None and not (tlds.isConstantExpression and isinstance(tlds.dataType, T.StringType)):
            raise ValueError("tlds is a constant text, with blanks between the domains")
        return AnalyzeResult(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("start", T.IntegerType())]))

    def eval(self, text: str | None, tlds: str | None = None) -> Iterator[tuple]:
        known, ord_ = lex.TLDS | set((tlds or "").lower().split()), 0
        for m in WRITTEN.finditer(text or ""):
            url = m[0].rstrip(MARKS)
            host = re.sub(r"^[a-z]+://", "", url, flags=re.IGNORECASE)
            host = re.split(r"[/?#:]", host, maxsplit=1)[0].rpartition("@")[2].lower()
            if "." in host and host.rpartition(".")[2] in known:
                yield ord_, url, host, m.start()
                ord_ += 1


def _standalone(texts: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or u is None else standing(t.lower(), [u.lower()])[0] for t, u in zip(texts, links, strict=True)], dtype="Int32")


def _rounded(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([v if pd.isna(v) or pd.isna(d) or v in (float("inf"), float("-inf")) else round(v, int(d)) for v, d in zip(values, digits, strict=True)], dtype="float64")


def register(spark: SparkSession) -> None:
    """Register extract_urls, standalone_count(text, link) and exact_round(value, digits); again is no harm."""
    spark.udtf.register("extract_urls", F.udtf(ExtractUrls))
    spark.udf.register("standalone_count", F.pandas_udf(_standalone, T.IntegerType()))
    spark.udf.register("exact_round", F.pandas_udf(_rounded, T.DoubleType()))
