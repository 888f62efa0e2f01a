"""Best-fit packing of token sequences under token, document-count and attention-cost limits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import as_bytes, encoder
from .workspace import Workspace

#: Bytes of ids in an Arrow batch.
BATCH_BYTES = 4 << 20
PIECE_FIELDS = "piece int, start long, length int, ids binary, part int, local_rank long"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens, pieces, and attention cost (the sum of squared piece lengths)."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    def __post_init__(self):
        if self.tokens < 1 or self.documents < 1 or self.attention < self.tokens**2:
            raise ValueError("limits must allow a piece of full length")


def token_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, piece, start, length, ids, part, local_rank): token pieces of at most ``capacity`` ids.

    A document's ids (little-endian unsigned 32-bit) end with ``end_id``; longer ones are cut so that only the first
    piece may be shorter than capacity. Null text counts as empty. ``part`` is the task that made a piece and
    ``local_rank`` its number among that task's pieces of equal length; both hold once the table is stored. Rows repeated, and
    rows without an id, have pieces each; long texts are encoded whole; an empty table has none; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = encoder(tokenizer_path, "bytes"), TaskContext.get().partitionId()
        seen, held, size = np.zeros(capacity + 1, np.int64), [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            i, piece, start, length, ids, rank = zip(*rows, strict=True)
            types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip((piece, start, length, ids, [part] * len(rows), rank), types, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(i, id_type), *columns], ["id", "piece", "start", "length", "ids", "part", "local_rank"]
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = b"".join(known.pieces(text, as_bytes)) + last
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    length = min(n - at, (n - at) % capacity or capacity)
                    held.append((i, piece, at, length, ids[4 * at : 4 * (at + length)], int(seen[length])))
                    seen[length] += 1
                    at, piece = at + length, piece + 1
                size += len(ids)
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {PIECE_FIELDS}")
    return out.withColumnRenamed("id", id_col)


@dataclass
class Placements:
    """Runs of equal pieces: pieces ``rank .. rank+count-1`` of a length go to sequences ``first ..`` at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int


def best_fit(
    counts: dict[int, int], limits: Limits, choose: str = "norm", weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
) -> Placements:
    """Vector best-fit decreasing over the number of pieces of each length.

    Sequences with equal contents are one state (residual tokens, documents, attention; how many; the first number), so
    the work follows the number of distinct lengths and not the number of pieces. ``choose``: ``norm`` takes the state
    with the least weighted norm of what would remain, ``dot`` the one with the largest weighted dot product of the
    piece's and the state's shares; only states where the piece fits under every limit are eligible. Ties go to the
    oldest state. A new sequence opens only where no state is eligible.
    """
    if choose not in ("norm", "dot"):
        raise ValueError("choose is 'norm' or 'dot'")
    cap = np.array([limits.tokens, limits.documents, limits.attention], np.float64)
    w = np.array(weights)
    room, many, first = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sequences, out = 0, []

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        while left:
            fits = (room >= need).all(axis=1)
            if fits.any():
                at = np.flatnonzero(fits)
                if choose == "norm":
                    k = at[np.argmin(((((room[at] - need) / cap) ** 2) * w).sum(axis=1))]
                else:
                    k = at[np.argmax(((room[at] / cap) * (need / cap) * w).sum(axis=1))]
                state, there, begin = room[k], int(many[k]), int(first[k])
                each = int((state // need).min()) if choose == "norm" else 1
            else:
                k, state, begin = -1, cap.astype(np.int64), sequences
                each = int((state // need).min()) if choose == "norm" else 1
                there = -(-left // each)
                sequences += there
            whole = min(there, left // each)
            rest = left - whole * each if whole < there else 0  # pieces of one more sequence that isn't filled
            for j in range(each):
                if n := whole + (j < rest):
                    out.append((length, rank, n, begin, limits.tokens - int(state[0]) + j * length))
                    rank += n
            left -= whole * each + rest
            parts = [(state - need * each, whole, begin)]
            if rest:
                parts.append((state - need * rest, 1, begin + whole))
            if (unused := there - whole - (rest > 0)) > 0:
                parts.append((state, unused, begin + whole + (rest > 0)))
            parts = [p for p in parts if p[1] and p[0].min() > 0]
            keep = np.arange(len(many)) != k
            room = np.concatenate([room[keep], np.array([p[0] for p in parts], np.int64).reshape(-1, 3)])
            many = np.concatenate([many[keep], np.array([p[1] for p in parts], np.int64)])
            first = np.concatenate([first[keep], np.array([p[2] for p in parts], np.int64)])
    table = np.array(out, np.int64).reshape(-1, 5)
    return Placements(*table.T, sequences)


class Packing:
    """A plan over a stored table of pieces; ``place`` gives the sequence of each."""

    def __init__(self, pieces: DataFrame, limits: Limits, choose: str = "norm"):
        self.pieces, self.limits = pieces, limits
        per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(
            Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        self.bases = per_part.select("length", "part", (before - F.col("n")).alias("base"))
        #: At most ``limits.tokens`` rows, whatever the size of the corpus.
        counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
        self.plan = best_fit(counts, limits, choose)

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds sequence_id and offset to rows with the pieces' length, part and local_rank, which go.

        The plan goes to the executors with the task: its size is bounded by the number of distinct lengths.
        """
        plan = self.plan
        order = np.lexsort((plan.rank, plan.length))
        lengths, ranks, first, offset = (x[order] for x in (plan.length, plan.rank, plan.first, plan.offset))
        keys = lengths << 44 | ranks

        @F.pandas_udf("sequence_id long, offset long")
        def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
            rank = rank.to_numpy()
            k = np.searchsorted(keys, length.to_numpy().astype(np.int64) << 44 | rank, "right") - 1
            return pd.DataFrame({"sequence_id": first[k] + rank - ranks[k], "offset": offset[k]})

        keep = [c for c in rows.columns if c not in ("part", "local_rank")]
        return (
            rows.join(self.bases, ["length", "part"])
            .withColumn("placed", placed("length", F.col("base") + F.col("local_rank")))
            .select(*keep, "placed.sequence_id", "placed.offset")
        )

    def sequences(self) -> DataFrame:
        """(sequence_id, ids): the packed sequences themselves; a sequence holds at most ``limits.tokens`` ids."""
        row = F.struct("offset", "ids")
        gathered = self.place(self.pieces).groupBy("sequence_id").agg(F.sort_array(F.collect_list(row)).alias("x"))
        joined = F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
        return gathered.select("sequence_id", joined.alias("ids"))


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    limits: Limits = Limits(),
    choose: str = "norm",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Packing:
    """Tokenises, cuts and packs whole texts. An empty table gives no sequences; ties and repeated rows are packed each."""
    made = token_pieces(docs, tokenizer_path, end_id, limits.tokens, id_col, text_col)
    stored = Workspace(docs.sparkSession).store(made, "pieces")
    return Packing(stored, limits, choose)
