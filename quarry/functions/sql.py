"""For Spark SQL: a search as a view over a table, and the captures of a text as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.capture.profiles import extract, find_profile
from quarry.engine import Engine, Options
from quarry.operators.results import public_matches
from quarry.sources import files as S


def search_view(spark: SparkSession, view: str, table: str, path: str, text: str, query: str, keep: tuple[str, ...] = (), **options) -> None:
    """A temporary view of a query over the rows of a table or view: its plan is the query's own, so conditions on the view and
    the query's conditions reach the table's scan together. ``path`` and ``text``: SQL expressions over the table; ``keep``:
    columns of the table that the view has, too."""
    corpus = S.from_table(spark.table(table), F.expr(path), F.expr(text), root="/", keep=keep)
    found = public_matches(Engine(spark, corpus, Options(**options)).search(query).results)
    found.select("display_path", *keep, "whole", "content_state", "matches").createOrReplaceTempView(view)


def register(spark: SparkSession) -> None:
    """The table function ``query_captures(language, key, text)``."""

    @F.udtf(returnType="text string, start_byte bigint, end_byte bigint, start_row int")
    class QueryCaptures:
        def eval(self, language: str, key: str, text: str):
            profile = find_profile(language)
            for _, t, (a, z, row, *_) in extract(profile, text or "", (key,)) if profile else ():
                yield t, a, z, row

    spark.udtf.register("query_captures", QueryCaptures)
