"""Token counts at every prefix of a text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .word_kernels import slices

LOW = (1 << 32) - 1
PREFIX_TYPE = "array<struct<n_bytes:int,n_tokens:int>>"


def token_prefixes(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, prefix_bytes, prefix_tokens): the table of exact token counts of every prefix of a text.

    Entry i says that the first i characters are ``prefix_bytes[i]`` bytes (UTF-8) and take ``prefix_tokens[i]`` tokens.
    Entry 0 is the empty prefix, the last is the whole text. Counts inside a chunk follow by dynamic programming over its
    prefixes (``ChunkEncoder.prefix_counts``) and add to the count at its start, as no token crosses the end of a chunk.
    Null text counts as empty; special strings are counted as the tokenizer file's library does by default. Texts are
    counted whole, a very long one as a row of its own size; rows repeated are answered each; an empty table gives an empty
    result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    arrow_id = pa.string() if kind.simpleString() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path, "prefixes")
        for batch in batches:
            for at, n, data, offsets in slices(batch.column(1)):
                texts = batch.column(1).slice(at, n).to_pylist()
                steps = b"".join(b"".join(known.pieces(text, known.prefix_steps)) for text in texts)
                grown = np.cumsum(np.concatenate([[0], np.frombuffer(steps, "<i2")]), dtype=np.int64)
                begins = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
                chars = np.searchsorted(begins, offsets)
                ends = chars + np.arange(n + 1)  # a row has an entry more than characters
                row = np.repeat(np.arange(n), np.diff(ends))
                entry = np.arange(ends[-1]) - row
                sizes = np.append(begins, len(data))[entry] - offsets[row]
                sizes[ends[1:] - 1] = np.diff(offsets)
                tokens = grown[entry] - grown[chars[row]]
                bounds = pa.array(ends.astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (sizes, tokens)]
                ids = batch.column(0).slice(at, n)
                yield pa.RecordBatch.from_arrays(
                    [ids if arrow_id is None else ids.cast(arrow_id), pa.array(np.diff(offsets)), *lists],
                    ["id", "n_bytes", "prefix_bytes", "prefix_tokens"],
                )

    out = rows.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, prefix_bytes array<int>, prefix_tokens array<int>")
    return out.withColumnRenamed("id", id_col)


class PrefixCounts:
    """Answers about one text from its table, without encoding anything where the table has every prefix.

    A table of some prefixes only, the ends of chunks, is filled in by the same dynamic programming for the chunk asked for.
    """

    def __init__(self, text: str, prefix_bytes: list[int], prefix_tokens: list[int], tokenizer_path: str):
        self.raw, self.ends, self.counts = text.encode(), list(prefix_bytes), list(prefix_tokens)
        self.path, self.inner = tokenizer_path, {}
        #: The least count at an entry or after it.
        self.least = np.minimum.accumulate(np.array(self.counts)[::-1])[::-1].tolist()

    def _chunk(self, i: int) -> tuple[list[int], list[int]]:
        """Ends and counts of all prefixes, by whole characters, from entry i to the next."""
        if i not in self.inner:
            start = self.ends[i]
            text = self.raw[start : self.ends[i + 1]].decode()
            if len(text) == 1:
                return self.ends[i : i + 2], self.counts[i : i + 2]
            inner = encoder(self.path, "prefixes").prefix_counts(text)
            ends = np.cumsum([start, *(len(c.encode()) for c in text)]).tolist()
            self.inner[i] = ends, [self.counts[i] + c for c in (0, *inner)]
        return self.inner[i]

    def count(self, n_bytes: int) -> int:
        """Tokens of the first n_bytes bytes, which must end a character."""
        i = bisect_right(self.ends, n_bytes) - 1
        if self.ends[i] == n_bytes:
            return self.counts[i]
        ends, counts = self._chunk(i)
        return counts[ends.index(n_bytes)]

    def longest_within(self, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens.

        It ends at the last entry within the budget, or between that entry and the next.
        """
        i = bisect_right(self.least, budget) - 1
        if i == len(self.counts) - 1:
            return self.ends[-1]
        ends, counts = self._chunk(i)
        return max(e for e, c in zip(ends, counts, strict=True) if c <= budget)
