"""Line dedup by the share of a host's pages that hold a line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LineDedupParams:
    """A line is boilerplate of a host where over ``ratio`` of the host's pages hold it, and ``pages`` of them at least."""

    ratio: float = 0.1
    pages: int = 5


def boilerplate(lines: DataFrame, totals: DataFrame, params: LineDedupParams) -> DataFrame:
    """(host, key) of boilerplate lines from distinct (host, page, key) and (host, total)."""
    counts = lines.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= params.pages)
    return counts.join(totals, "host").filter(F.col("n") > F.col("total") * F.lit(params.ratio)).select("host", "key")


def line_dedup(
    pages: DataFrame,
    params: LineDedupParams = LineDedupParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, text_col, n_lines, n_dropped, *carry) for every row: the text without its host's boilerplate lines.

    Rows of one host with equal texts are one page, so copies of a page do not turn its lines into boilerplate. A line
    counts once per page however often it stands there, and all its places go. Blank lines stay and never count. ``host``
    defaults to the column ``source``; pages of a null host make up a host of their own. Null texts stay null with no
    lines; an empty text has one line; a page whose lines all go has an empty text. Rows repeated with one id lose the lines
    of each other's places only where their texts are equal. An empty table gives an empty result. Other columns are
    not read, but for those in ``carry``, which stay as they are.

    Only 64-bit hashes of lines and texts are shuffled for the counts, made distinct within tasks first; a page's text is
    shuffled once, to meet the places of its own boilerplate lines.
    """
    host = F.col("source") if host is None else host
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.col(text_col)).alias("page"),
        F.struct(*(F.col(c) for c in carry)).alias("carried") if carry else F.lit(None).alias("carried"),
    )
    key = lambda line: F.when(F.trim(line) != "", F.xxhash64(line))
    keyed = rows.filter("text is not null").select("id", "host", "page", F.transform(F.split("text", "\n"), key).alias("keys"))
    totals = keyed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = keyed.select("host", "page", F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null").distinct()
    found = boilerplate(lines, totals, params)
    spots = keyed.select("id", "host", "page", F.posexplode("keys").alias("pos", "key")).filter("key is not null")
    marked = spots.join(found, ["host", "key"], "left_semi").groupBy("id", "page").agg(F.collect_set("pos").alias("drop"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("drop", i))
    return rows.join(marked, ["id", "page"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        *(F.col("carried")[c].alias(c) for c in carry),
    )
