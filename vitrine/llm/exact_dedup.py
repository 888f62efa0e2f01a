"""Exact dedup with a log-structured merge index of text digests, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: A run's filter has this many bits in words of ``WORD`` bits: 16 MB however many digests there are.
FILTER_BITS, WORD = 1 << 27, 1 << 15


def _filter_place(digest: Column) -> tuple[Column, Column]:
    """Word and bit of a digest in a filter: its own first bytes, which are as good as random."""
    place = F.conv(F.substring(F.hex(digest), 1, 12), 16, 10).cast("long") % FILTER_BITS
    return F.floor(place / WORD).cast("long"), place % WORD


def run_filter(digests: DataFrame) -> DataFrame:
    """(word, bits) of a filter over (digest): at most ``FILTER_BITS / WORD`` rows of ``WORD`` bits."""
    word, bit = _filter_place(F.col("digest"))
    return digests.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(rows: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows whose digest the filter may hold: all that it does hold, and few others while it is sparse.

    The filter goes to all executors; its size is bounded by its number of bits.
    """
    word, bit = _filter_place(F.col("digest"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = rows.withColumn("word", word).withColumn("bit", bit)
    met = placed.join(F.broadcast(filters), "word")
    return met.filter(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).select(*rows.columns)


class DigestIndex:
    """Sorted runs of (digest, keep_id, n) in level 0, merged into level 1 by ``compact``."""

    def __init__(self, workspace: Workspace, keep: str = "min"):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.workspace, self.pick, self.runs = workspace, F.min if keep == "min" else F.max, []

    def flush(self, rows: DataFrame, memtables: int) -> None:
        """Flushes rows (id, digest) as ``memtables`` sorted runs; input partitions are dealt to memtables in turn.

        The partial aggregate of each task is the memtable's hash map: copies meet there before anything is shuffled.
        """
        name = f"level0_{len(self.runs)}"
        run = (
            rows.select(F.pmod(F.spark_partition_id(), F.lit(memtables)).alias("run"), "digest", "id")
            .groupBy("run", "digest")
            .agg(self.pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
            .sortWithinPartitions("run", "digest")
        )
        self.runs.append((name, self.workspace.store(run, name, partition_by=["run"])))

    def compact(self) -> DataFrame:
        """Merges all runs: one row per digest with the identifier that stays and the number of rows."""
        merged = None
        for _, run in self.runs:
            run = run.select("digest", "keep_id", "n")
            merged = run if merged is None else merged.unionByName(run)
        level1 = (
            merged.groupBy("digest")
            .agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
            .sortWithinPartitions("digest")
        )
        out = self.workspace.store(level1, "level1")
        self.workspace.drop(*(name for name, _ in self.runs))
        self.runs = []
        return out


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", memtables: int = 8
) -> DataFrame:
    """Groups rows of equal text: (id_col, keep_id, group_size, kept, digest).

    ``keep`` says whether the smallest or the largest identifier of a group stays. Null text counts as empty text. Rows
    with a null identifier belong to their group but stay only where the group has no other identifier (keep_id is null
    then). Rows repeated with one identifier are all kept or all dropped. An empty table gives an empty result. Other
    columns are not read.

    Texts of equal digest are compared byte by byte: rows whose digest the filter of repeated digests may hold are
    grouped by digest, within tasks first, and the least text must be the greatest one. Should two texts share a digest,
    their rows are grouped by the text itself. Very long texts meet only where their digest is repeated.
    """
    workspace = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn(
        "digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    )
    index = DigestIndex(workspace, keep)
    index.flush(rows.select("id", "digest"), memtables)
    hits = index.compact().filter("n > 1")
    filters = workspace.store(run_filter(hits), "filter")
    collided = workspace.store(collisions(may_hold(rows.select("digest", "text"), filters)), "collided")

    placed = rows.select("id", "digest").join(hits, "digest", "left")
    if not collided.isEmpty():
        whole = rows.join(collided, "digest")
        placed = placed.join(collided, "digest", "left_anti").unionByName(_by_text(whole, index.pick))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return placed.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.col("digest"),
    )


def collisions(rows: DataFrame) -> DataFrame:
    """(digest) of rows (digest, text) that have several texts."""
    spread = rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    return spread.filter(F.col("least") != F.col("greatest")).select("digest")


def _by_text(rows: DataFrame, pick) -> DataFrame:
    groups = rows.groupBy("text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return rows.select("id", "digest", "text").join(groups, "text").select("digest", "id", "keep_id", "n")
