"""Vector columns: products, norms, distances; and block products of two sets of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most vectors that one side of a comparison may send to every executor.
BROADCAST_VECTORS = 50_000
#: Vectors of each side in a task where neither side is sent.
CHUNK_VECTORS = 4_096


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine, the cosine held within [-1, 1]; NaN where a vector is zero, null where one is null."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    cosine = F.try_divide(dot(a, b), size)
    held = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))  # these two pass over nulls
    return F.when(size == 0, F.lit(float("nan"))).when(cosine.isNotNull(), 1 - held)


def normalise(a: Column) -> Column:
    """The vector over its length; a zero vector gives null elements."""
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), norm(a)))


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda s, y: s + y))


@dataclass(frozen=True)
class Block:
    """Rows of one width: their ids and vectors; a null element is NaN."""

    ids: np.ndarray
    rows: np.ndarray

    def unit(self) -> np.ndarray:
        """The rows over their lengths; NaN where a row is zero."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.rows / np.sqrt((self.rows * self.rows).sum(axis=1, keepdims=True))


def _blocks(frame: pd.DataFrame, size: int) -> Iterator[Block]:
    frame = frame[frame["vector"].notna()]
    for _, same in frame.groupby(frame["vector"].map(len)):
        for at in range(0, len(same), size):
            part = same.iloc[at : at + size]
            yield Block(part["id"].to_numpy(), np.array(part["vector"].to_list(), np.float64).reshape(len(part), -1))


def block_products(
    left: DataFrame, right: DataFrame, keep: Callable[[Block, Block], pd.DataFrame], schema: str,
    most: int = BROADCAST_VECTORS, chunk: int = CHUNK_VECTORS, block: int = 512,
) -> DataFrame:
    """Every block of left with every block of right, both (id, vector): ``keep`` gives rows of ``schema`` for two blocks.

    Up to ``most`` right rows go to all executors. More are dealt, as are those of left, over chunks of about ``chunk`` rows
    by the hash of the id, and a task has one chunk of each side, whatever the number of rows. What ``keep`` gives
    for a row is therefore to be merged over blocks. Null vectors, and pairs of vectors of different widths, give nothing.
    """

    def meet(mine: Iterator[Block], others: list[Block]) -> Iterator[pd.DataFrame]:
        for a in mine:
            for b in others:
                if a.rows.shape[1] == b.rows.shape[1]:
                    yield keep(a, b)

    if right.limit(most + 1).count() <= most:
        shared = right.sparkSession.sparkContext.broadcast(list(_blocks(right.toPandas(), most)))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield from meet(_blocks(frame, block), shared.value)

        return left.mapInPandas(run, schema)

    def cell(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        others = b.rename(columns={"other": "id", "other_vector": "vector"})
        found = list(meet(_blocks(a, block), list(_blocks(others, 4 * block))))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=names)

    names = left.sparkSession.createDataFrame([], schema).columns
    rows, columns = (max(1, -(-df.count() // chunk)) for df in (left, right))
    def chunk_of(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n).cast("long"))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # other names: with the same columns on both sides, the optimiser takes one side's for the other's
    renamed = right.select(F.col("id").alias("other"), F.col("vector").alias("other_vector"))
    dealt = left.select("id", "vector", chunk_of("id", rows).alias("i")).withColumn("j", all_of(columns))
    met = renamed.withColumn("j2", chunk_of("other", columns)).withColumn("i2", all_of(rows))
    return dealt.groupBy("i", "j").cogroup(met.groupBy("i2", "j2")).applyInPandas(cell, schema)
