"""Catalogue search: rows (id, downloads, likes, tags, pipeline_tag)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TASK = "text-generation"


def generates_text():
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return F.array_contains(tags, TASK) | (F.coalesce("pipeline_tag", F.lit("")) == TASK)


def search(
    catalogue: DataFrame, query: str, models_only: bool = True, limit: int = 20, keep: int = 10
) -> DataFrame:
    """The most downloaded matches, shown from the tail.

    The first `limit` matches by downloads are taken, then reversed, then filtered, then cut
    to `keep`: the limit comes before the filter. Ties go by id.
    """
    match = catalogue.filter(F.contains(F.lower("id"), F.lit(query.lower())))
    top = match.orderBy(F.coalesce("downloads", F.lit(0)).desc(), "id").limit(limit)
    # at most `limit` rows from here on
    ranked = top.withColumn(
        "rank",
        F.row_number().over(Window.orderBy(F.coalesce("downloads", F.lit(0)).desc(), "id")),
    )
    if models_only:
        ranked = ranked.filter(generates_text())
    shown = ranked.orderBy(F.col("rank").desc()).limit(keep)
    return shown.select(
        F.row_number().over(Window.orderBy(F.col("rank").desc())).alias("number"),
        "id",
        F.coalesce("downloads", F.lit(0)).alias("downloads"),
        F.coalesce("likes", F.lit(0)).alias("likes"),
    )
