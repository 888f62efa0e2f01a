"""Katz back-off model of any order: Good-Turing discounts, exactly normalised back-off weights, recursive scoring.

All counts of the training texts are kept. Texts are cut into blocks of some million tokens, and only sorted, delta-coded
arrays of a block's distinct words and grams travel, one row for each block and slot of words or histories: a row for
every token would be many times as large. A word gets a number by its count, the most frequent first, so numbers are small
where they are many, and the count, and with it the probability of the word alone, follows from the number.

Grams are counted one length after the other. A gram is asked for only if its history, as a shorter gram, is in the training
texts, and with it travels the count of its ending, the gram that backing off leads to: a history's weight follows from the
discounted counts of its grams and of their endings.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .word_kernels import mix, slices, words
from .workspace import Workspace

#: One schema for all that is exchanged.
ROWS = "kind int, slot long, block long, n long, m long, payload binary"
#: Kinds of rows, in the order in which a block or slot reads them. Answers on grams of 3 and more words have the kinds after these.
TEXTS, WORDS, TOKENS, MODEL, REQUEST, ANSWER, PAIR_ANSWER, HISTOGRAM, HOT, HEAVY = range(10)
#: Numbers of words: the unknown one, the beginning of a text (as a history), and the first of the others. The end of a text is
#: a word with a hash of its own.
UNKNOWN, BEGIN, FIRST, END_HASH = 0, 1, 2, np.uint64(1)
#: Blocks ask for grams of 3 and more words in so many rounds, each for a share of the slots, so that fewer are on disk at once.
ROUNDS = 2
#: Probabilities are summed as multiples of this, so a sum does not depend on the order.
GRAIN = 2.0**-60


@dataclass(frozen=True)
class KatzParams:
    """Counts up to ``discounted`` are discounted after Good and Turing. A block closes at ``flush`` tokens, and a slot is to
    hold about ``slot`` of the words or grams that blocks ask for; both bound memory and have no part in the result. Grams
    have up to ``order`` words, 2 at least.
    """

    discounted: int = 5
    flush: int = 1_000_000
    slot: int = 1_500_000
    order: int = 2

    def __post_init__(self):
        if self.order < 2:
            raise ValueError("order must be 2 or more")


def _squeeze(x: np.ndarray, sorted_values: bool) -> bytes:
    """Byte planes of the values, or of their differences, compressed; as many planes as the largest one needs."""
    x = np.ascontiguousarray(x).view(np.int64) if len(x) else np.zeros(0, np.int64)
    if sorted_values:
        x = np.diff(x, prepend=np.int64(0))
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    width = 8 if low < 0 else max(1, (high.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width, sorted_values]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def pack(*arrays: tuple[np.ndarray, bool]) -> bytes:
    """64-bit arrays of equal length, each with whether its differences are smaller than its values."""
    parts = [_squeeze(np.asarray(a), rising) for a, rising in arrays]
    return b"".join([*(len(p).to_bytes(4, "little") for p in parts), *parts])


def unpack(payload: bytes, n: int, count: int) -> list[np.ndarray]:
    sizes = [int.from_bytes(payload[4 * i : 4 * i + 4], "little") for i in range(count)]
    out, at = [], 4 * count
    for size in sizes:
        width, rising = payload[at], payload[at + 1]
        raw = pa.decompress(payload[at + 2 : at + size], decompressed_size=width * n, codec="zstd", asbytes=True)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        x = full.view(np.int64).ravel()
        out.append(np.cumsum(x) if rising else x)
        at += size
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def pack_grams(columns: list[np.ndarray], *told: np.ndarray) -> bytes:
    """Grams sorted by their words, a column for each place: a word as a difference where those before it are the same."""
    same = np.ones(len(columns[0]), bool)
    steps = [(columns[0], True)]
    for before, x in zip(columns, columns[1:], strict=False):
        same[1:] &= before[1:] == before[:-1]
        step = x.copy()
        step[1:] -= np.where(same[1:], x[:-1], 0)
        steps.append((step, False))
    return pack(*steps, *((x, False) for x in told))


def unpack_grams(payload: bytes, n: int, words: int, told: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    first, *rest = unpack(payload, n, words + told)
    columns, new = [first], np.zeros(n, bool)
    new[:1] = True
    for step in rest[: words - 1]:
        new[1:] |= columns[-1][1:] != columns[-1][:-1]
        starts = np.flatnonzero(new)
        total = np.cumsum(step)
        before = total[starts] - step[starts]
        columns.append(total - np.repeat(before, np.diff(np.append(starts, n))))
    return columns, rest[words - 1 :]


def pack_pairs(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams sorted by history and word."""
    return pack_grams([h, w], n)


def unpack_pairs(payload: bytes, n: int) -> list[np.ndarray]:
    columns, told = unpack_grams(payload, n, 2, 1)
    return [*columns, *told]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "slot", "block", "n", "m", "payload"]
    )


def _read(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows (kind, slot, block, n, m, payload) of one slot (1) or block (2) after the other, as they are sorted."""
    now, held = None, []
    for batch in batches:
        for row in _read(batch):
            if row[column] != now and held:
                yield now, held
                held = []
            now = row[column]
            held.append(row)
    if held:
        yield now, held


def _by_slot(slot: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The stable order by slot, and (slot, begin, end) there."""
    order = np.argsort(slot, kind="stable")
    ordered = slot[order]
    starts = _runs(ordered)
    return order, list(zip(ordered[starts].tolist(), starts.tolist(), np.append(starts, len(slot))[1:].tolist(), strict=True))


def _modulo(x: np.ndarray, n: int) -> np.ndarray:
    return (x.astype(np.uint64, copy=False) % np.uint64(n)).astype(np.int64)


def blocks(docs: DataFrame, params: KatzParams) -> DataFrame:
    """Packed blocks of (id, text, training): a row of texts, one of distinct words by hash, and one of tokens each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, held, lengths, told, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush() -> pa.RecordBatch:
            block = part << 32 | done
            ids, nulls, train = (np.concatenate([x[i] for x in told]) for i in range(3))
            n_tokens, token = np.concatenate(lengths), np.concatenate(held)
            found, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
            trained = np.bincount(inverse, np.repeat(train, n_tokens), len(found)).astype(np.int64)
            rank = np.empty(len(found), np.int64)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(found))
            texts = pack((ids, False), (nulls, False), (train, False), (n_tokens, False))
            return _table(
                [
                    (TEXTS, -1, block, len(ids), 0, texts),
                    (WORDS, -1, block, len(found), 0, pack((found, True), (count, False), (trained, False))),
                    (TOKENS, -1, block, len(token), 0, pack((rank[inverse], False))),
                ]
            )

        for batch in batches:
            ids = batch.column(0)
            told_all = (
                ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                np.asarray(ids.is_null()).astype(np.int64),
                np.asarray(batch.column(2).fill_null(False)).astype(np.int64),
            )
            for at, rows, data, offsets in slices(batch.column(1)):
                hashes, ends = words(data, offsets)
                n = np.diff(ends) + 1
                last = np.cumsum(n) - 1
                token = np.full(len(hashes) + rows, END_HASH)
                inner = np.ones(len(token), bool)
                inner[last] = False
                token[inner] = np.maximum(hashes, END_HASH + np.uint64(1))
                held.append(token)
                lengths.append(n)
                told.append([x[at : at + rows] for x in told_all])
                size += len(token)
                if size >= params.flush:
                    yield flush()
                    held, lengths, told, size, done = [], [], [], 0, done + 1
        if held:
            yield flush()

    return docs.select("id", "text", "training").mapInArrow(run, ROWS)


def _word_requests(stored: DataFrame, slots: int) -> DataFrame:
    """Rows of words (block, WORDS) as one row for each slot of hashes with the words' counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block, n, _, payload in _read(batch):
                found, _, trained = unpack(payload, n, 3)
                order, parts = _by_slot(_modulo(found.view(np.uint64), slots))
                found, trained = found[order], trained[order]
                yield _table([(REQUEST, s, block, b - a, 0, pack((found[a:b], True), (trained[a:b], False))) for s, a, b in parts])

    return stored.mapInArrow(run, ROWS)


def _word_slots(rows: DataFrame, partitions: int, keep: bool) -> DataFrame:
    """Sums counts by word: answers to the blocks (counts and places among the slot's words of equal count), the slot's part
    of the model, and how many words have each count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, group in _grouped(batches, 1):
            parts = [unpack(row[5], row[3], 2) for row in group]
            found, inverse = np.unique(np.concatenate([p[0] for p in parts]).view(np.uint64), return_inverse=True)
            count = np.zeros(len(found), np.int64)
            np.add.at(count, inverse, np.concatenate([p[1] for p in parts]))
            order = np.argsort(count, kind="stable")
            starts = _runs(count[order])
            sizes = np.diff(np.append(starts, len(order)))
            place = np.empty(len(found), np.int64)
            place[order] = np.arange(len(order)) - np.repeat(starts, sizes)
            known, at = count > 0, 0
            out = [(MODEL, slot, -1, int(known.sum()), 0, pack((found[known], True), (count[known], False)))] if keep else []
            out += [(HISTOGRAM, -1, c, n, n, None) for c, n in zip(count[order[starts]].tolist(), sizes.tolist(), strict=True) if c]
            for kind, _, block, n, _, _ in group:
                here = inverse[at : at + n]
                at += n
                if kind == REQUEST:
                    out.append((ANSWER, slot, block, n, 0, pack((count[here], False), (place[here], False))))
            yield _table(out)

    return rows.repartition(partitions, "slot").sortWithinPartitions("slot", "kind", "block").mapInArrow(run, ROWS)


@dataclass
class Unigrams:
    """What follows from how many words have each count: ``counts`` falling, the first number of each, discounts.

    There are fewer distinct counts than the root of twice the number of tokens.
    """

    counts: np.ndarray
    first: np.ndarray
    tokens: int
    types: int
    slots: int
    log_unknown: float
    p: np.ndarray
    hot: int

    @staticmethod
    def of(types_of: dict[int, int], places: dict[int, int], slots: int, k: int, share: float) -> Unigrams:
        counts = np.array(sorted(types_of, reverse=True), np.int64)
        spans = np.array([places[c] * slots for c in counts.tolist()], np.int64)
        first = FIRST + np.cumsum(spans) - spans
        types = np.array([types_of[c] for c in counts.tolist()], np.int64)
        tokens = int((types * counts).sum())
        cut = good_turing(types_of, k)
        discounts = np.array([cut.get(c, 1.0) for c in counts.tolist()])
        mass = float((types * counts * discounts).sum() / max(1, tokens))
        shrink = 1.0 if mass < 1 - 1e-12 or not tokens else tokens / (tokens + 1)
        unknown = 1 - mass * shrink
        often = int((counts > tokens * share).sum())
        return Unigrams(
            counts=counts,
            first=first,
            tokens=tokens,
            types=int(types.sum()),
            slots=slots,
            log_unknown=math.log10(unknown) if unknown > 0 else 0.0,
            p=counts * discounts * shrink / max(1, tokens),
            hot=int(first[often]) if often < len(counts) else int(FIRST + spans.sum()),
        )

    def numbers(self, count: np.ndarray, place: np.ndarray, slot: np.ndarray) -> np.ndarray:
        if not len(self.counts):
            return np.zeros(len(count), np.int64)
        at = np.minimum(np.searchsorted(-self.counts, -count), len(self.counts) - 1)
        return np.where(count > 0, self.first[at] + place * self.slots + slot, UNKNOWN)

    def count(self, number: np.ndarray) -> np.ndarray:
        """Of known words by their numbers."""
        return self.counts[np.searchsorted(self.first, number, "right") - 1]

    def probability(self, number: np.ndarray) -> np.ndarray:
        """Of words by their numbers; 0 for the unknown one."""
        at = np.searchsorted(self.first, number, "right") - 1
        return np.where(at >= 0, self.p[np.maximum(at, 0)], 0.0) if len(self.p) else np.zeros(len(number))


def good_turing(of_count: dict[int, int], k: int) -> dict[int, float]:
    """Discount of each count from ``of_count`` up to k, after Katz; 1 where the numbers of counts allow none."""
    n = lambda c: of_count.get(c, 0)
    common = (k + 1) * n(k + 1) / n(1) if n(1) else 0.0
    out = {}
    for c in range(1, k + 1):
        d = ((c + 1) * n(c + 1) / (c * n(c)) - common) / (1 - common) if n(c) and common < 1 else 1.0
        out[c] = d if 0 < d < 1 else 1.0
    return out


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) ^ (x.astype(np.uint64) + np.uint64(1)))
    return out


@dataclass
class HotHistories:
    """Histories of 2 and more words that a large share of all tokens follow, by the hashes of their words' numbers, and their
    sums. Their grams are dealt over all slots.
    """

    columns: list[np.ndarray]
    hashes: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(columns: list[np.ndarray], k: int) -> HotHistories:
        hashes = _hash(columns)
        order = np.argsort(hashes, kind="stable")
        return HotHistories([x[order] for x in columns], hashes[order], np.zeros((len(order), 2 * k + 1), np.int64))

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """Where each history is among these, -1 where it is not."""
        out = np.full(len(columns[0]), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, _hash(columns)), len(self.hashes) - 1)
            equal = np.logical_and.reduce([mine[at] == x for mine, x in zip(self.columns, columns, strict=True)])
            out[equal] = at[equal]
        return out


@dataclass
class Level:
    """What scoring takes from the grams of one length of 3 and more words."""

    words: int
    slots: int
    hot: HotHistories
    discounts: dict[int, float]

    @property
    def answer(self) -> int:
        return HEAVY + self.words - 2


class Block:
    """A block's texts with the numbers of their words, its distinct bigrams, and which of these each token ends."""

    def __init__(self, group: list[tuple], unigrams: Unigrams, pair_slots: int):
        own = {row[0]: row for row in group if row[0] <= TOKENS}
        self.ids, self.nulls, self.train, self.n_tokens = unpack(own[TEXTS][5], own[TEXTS][3], 4)
        found, count, _ = unpack(own[WORDS][5], own[WORDS][3], 3)
        (rank,) = unpack(own[TOKENS][5], own[TOKENS][3], 1)
        slot = _modulo(found.view(np.uint64), unigrams.slots)
        answers = [unpack(row[5], row[3], 2) for row in group if row[0] == ANSWER]
        order = np.argsort(slot, kind="stable")
        self.word_count, place = np.empty(len(found), np.int64), np.empty(len(found), np.int64)
        self.word_count[order] = np.concatenate([a[0] for a in answers])
        place[order] = np.concatenate([a[1] for a in answers])
        number = unigrams.numbers(self.word_count, place, slot)
        self.values, local = np.unique(np.append(number, [UNKNOWN, BEGIN]), return_inverse=True)
        self.word = np.argsort(-count, kind="stable").astype(np.int32)[rank]
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens
        self.follows = local[self.word].astype(np.int32)
        history = np.empty(len(self.follows), np.int64)
        history[1:] = self.follows[:-1]
        history[self.starts] = local[-1]
        #: Tokens after a known history; after an unknown one there is nothing to look up.
        self.asked = np.flatnonzero(self.values[history] != UNKNOWN)
        size = len(self.values)
        keys, self.gram = np.unique(history[self.asked] * size + self.follows[self.asked], return_inverse=True)
        self.gram = self.gram.astype(np.int32)
        self.columns = [self.values[keys // size], self.values[keys % size]]
        h, w = self.columns
        deal = mix(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.where(h < unigrams.hot, w, 0).astype(np.uint64))
        self.order, self.parts = _by_slot(_modulo(deal, pair_slots))

    def training(self, asked: np.ndarray, gram: np.ndarray, size: int) -> np.ndarray:
        """How often training texts have each gram."""
        return np.bincount(gram, np.repeat(self.train, self.n_tokens)[asked], size).astype(np.int64)

    def requests(self, block: int) -> list[tuple]:
        n = self.training(self.asked, self.gram, len(self.order))[self.order]
        h, w = (x[self.order] for x in self.columns)
        return [(REQUEST, s, block, b - a, 0, pack_pairs(h[a:b], w[a:b], n[a:b])) for s, a, b in self.parts]

    def answered(self, group: list[tuple]) -> list[tuple[np.ndarray, int, bytes]]:
        return _answered(self, [row for row in group if row[0] == PAIR_ANSWER])


class Grams:
    """A block's distinct grams of one length of 3 and more words whose histories are known, in the order of their words."""

    def __init__(self, block: Block, below: Block | Grams, level: Level):
        ends = np.full(len(block.follows), -1, np.int32)
        ends[below.asked] = below.gram
        inner = np.ones(len(ends), bool)
        inner[block.starts] = False
        known = np.zeros(len(ends), bool)
        known[below.asked] = below.count[below.gram] > 0
        inner[1:] &= known[:-1]
        self.level, self.asked = level, np.flatnonzero(inner)
        size = len(block.values)
        keys, first, self.gram = np.unique(
            ends[self.asked - 1].astype(np.int64) * size + block.follows[self.asked], return_index=True, return_inverse=True
        )
        #: The shorter grams that a gram begins with, its history, and ends with.
        self.gram, self.history = self.gram.astype(np.int32), (keys // size).astype(np.int32)
        self.ending = ends[self.asked[first]]
        self.columns = [*(x[self.history] for x in below.columns), block.values[keys % size]]
        self.hot = level.hot.find(self.columns[:-1])
        told = np.where(self.hot >= 0, self.columns[-1] + 1, 0).astype(np.uint64)
        self.order, self.parts = _by_slot(_modulo(mix(_hash(self.columns[:-1]) ^ told), level.slots))

    def requests(self, block: int, own: Block, below: Block | Grams, turn: int) -> list[tuple]:
        """Of the slots whose turn it is."""
        n = own.training(self.asked, self.gram, len(self.order))
        lower = np.where(n > 0, below.count[self.ending], 0)[self.order]
        columns, n = [x[self.order] for x in self.columns], n[self.order]
        return [
            (REQUEST, s, block, b - a, 0, pack_grams([x[a:b] for x in columns], n[a:b], lower[a:b]))
            for s, a, b in self.parts
            if s % ROUNDS == turn
        ]

    def answered(self, group: list[tuple]) -> list[tuple[np.ndarray, int, bytes]]:
        return _answered(self, [row for row in group if row[0] == self.level.answer])

    def weigh(self, told: list[tuple[np.ndarray, int, bytes]], below: Block | Grams, lower: dict[int, float], k: int) -> None:
        """Sets the logarithm of each gram's probability, and what counts of its history are divided by."""
        self.scale, back = np.ones(len(self.order)), np.zeros(len(self.order))
        own, ending = (np.array([c * (1 - d.get(c, 1.0)) for c in range(1, k + 1)]) for d in (self.level.discounts, lower))
        for here, m, payload in told:
            starts = _runs(self.history[here])
            hot, (of_history, of_endings) = self.hot[here][starts], _halves(payload)
            unseen = np.logical_or.reduceat(self.count[here] == 0, starts)
            sums = np.zeros((len(starts), 2 * k + 1), np.int64)
            sums[hot >= 0] = self.level.hot.sums[hot[hot >= 0]]
            sums[hot < 0, :k] = np.column_stack(unpack(of_history, m, k))
            ask = (hot < 0) & unseen
            sums[ask, k:] = np.column_stack(unpack(of_endings, int(ask.sum()), k + 1))
            total, scale_below = below.count[self.history[here]][starts], below.scale[self.ending[here]][starts]
            lost = sums[:, :k] @ own
            # where nothing is left for unseen words, one more occurrence of the history makes room
            scale = np.where(lost <= 1e-9, total + 1.0, total)
            left = (scale_below - sums[:, -1] + sums[:, k:-1] @ ending) / scale_below
            weight = np.log10((scale - total + lost) / scale) - np.log10(np.where(unseen, left, 1.0))
            each = np.diff(np.append(starts, len(here)))
            self.scale[here], back[here] = np.repeat(scale, each), np.repeat(weight, each)
        seen = self.count > 0
        met = np.log10(np.where(seen, self.count * _cut(self.level.discounts, k)[np.minimum(self.count, k + 1)], 1) / self.scale)
        self.value = np.where(seen, met, back + below.value[self.ending])


def _answered(grams: Block | Grams, answers: list[tuple]) -> list[tuple[np.ndarray, int, bytes]]:
    """Sets the grams' counts; the places of each slot's grams with what it tells of their histories."""
    grams.count, out = np.empty(len(grams.order), np.int64), []
    for (_, begin, end), (_, _, _, n, m, payload) in zip(grams.parts, answers, strict=True):
        here = grams.order[begin:end]
        counts, told = _halves(payload)
        (grams.count[here],) = unpack(counts, n, 1)
        out.append((here, m, told))
    return out


def _cut(discounts: dict[int, float], k: int) -> np.ndarray:
    out = np.ones(k + 2)
    for c, d in discounts.items():
        out[c] = d
    return out


def _pair_requests(rows: DataFrame, unigrams: Unigrams, slots: int, partitions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _grouped(batches, 2):
            if out := Block(group, unigrams, slots).requests(block):
                yield _table(out)

    return _at_blocks(rows, partitions).mapInArrow(run, ROWS)


def _at_blocks(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "block").sortWithinPartitions("block", "kind", "slot")


def _pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for each distinct pair, in the order of the pairs."""
    wide = int(w.max()) + 1 if len(w) else 1
    if len(h) and (int(h.max()) + 1) * wide >= 1 << 63:
        h, w = (np.unique(x, return_inverse=True)[1] for x in (h, w))
        wide = int(w.max()) + 1
    return h * wide + w


def _pair_slots(rows: DataFrame, unigrams: Unigrams, k: int, partitions: int, heavy: float, keep: bool) -> DataFrame:
    """Sums counts by bigram: answers to the blocks, the slot's part of the model, how many bigrams have each count, and the
    sums of histories.

    An answer has the count of every bigram asked for and, for every history, what its weight follows from once the
    discounts are known: how many of its bigrams have each discounted count, and the mass of the words not seen after it
    (the sum of all counts is the history's own count). Histories dealt over all slots have their sums in rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, group in _grouped(batches, 1):
            parts = [unpack_pairs(row[5], row[3]) for row in group]
            h, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first, inverse = np.unique(_pair_keys(h, w), return_index=True, return_inverse=True)
            count = np.zeros(len(first), np.int64)
            np.add.at(count, inverse, n)
            h1, w1 = h[first], w[first]
            seen = count > 0
            hs, ws, cs = h1[seen], w1[seen], count[seen]
            of, owner = np.unique(hs, return_inverse=True)
            sums = np.zeros((len(of), k + 2), np.int64)
            small = cs <= k
            np.add.at(sums, (owner[small], cs[small] - 1), 1)
            np.add.at(sums[:, k], owner, cs)
            np.add.at(sums[:, k + 1], owner, np.rint(unigrams.probability(ws) / GRAIN).astype(np.int64))
            out = [(MODEL, slot, -1, len(hs), 0, pack_pairs(hs, ws, cs))] if keep else []
            out += [(HISTOGRAM, -1, c, m, 0, None) for c, m in enumerate(np.bincount(cs[cs <= k + 1], minlength=1).tolist()) if m]
            out += _heavy([hs, ws], cs, heavy)
            for i in np.flatnonzero(of < unigrams.hot).tolist():
                out += [(HOT, int(of[i]), c, x, 0, None) for c, x in enumerate(sums[i].tolist()) if x]
            at = 0
            for (kind, _, block, size, _, _), (h_part, _, _) in zip(group, parts, strict=True):
                here = inverse[at : at + size]
                at += size
                if kind == REQUEST:
                    own = h_part[_runs(h_part)]
                    own = np.searchsorted(of, own[own >= unigrams.hot])
                    told = [(x, False) for x in (*sums[own, :k].T, _used(sums[own, k + 1]).view("<u4").astype(np.int64))]
                    out.append((PAIR_ANSWER, slot, block, size, len(own), _two(pack((count[here], False)), pack(*told))))
            yield _table(out)

    return rows.repartition(partitions, "slot").sortWithinPartitions("slot", "kind", "block").mapInArrow(run, ROWS)


def _heavy(columns: list[np.ndarray], count: np.ndarray, heavy: float) -> list[tuple]:
    """The grams that occur more often than ``heavy`` times: hot histories of the next length."""
    often = count > heavy
    return [(HEAVY, -1, -1, int(often.sum()), 0, pack_grams([x[often] for x in columns]))] if often.any() else []


def _gram_requests(rows: DataFrame, model: KatzModel, level: Level, partitions: int, turn: int) -> DataFrame:
    own = model.totals()

    def asked(block: int, group: list[tuple]) -> list[tuple]:
        below = b = Block(group, own.unigrams, own.pair_slots)
        b.answered(group)
        for known in own.levels:
            if known.words < level.words:
                below = Grams(b, below, known)
                below.answered(group)
        return Grams(b, below, level).requests(block, b, below, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in _grouped(batches, 2):
            if out := asked(block, group):
                yield _table(out)

    return _at_blocks(rows, partitions).mapInArrow(run, ROWS)


def _gram_slots(rows: DataFrame, level: Level, k: int, partitions: int, heavy: float, keep: bool) -> DataFrame:
    """Sums counts by gram, as ``_pair_slots`` does by bigram.

    An answer has the count of every gram asked for; for every history, how many of its grams have each discounted count;
    and for every history of a gram asked for that is in no training text, how many of the endings of its grams have each
    discounted count, and the sum of the endings' counts.
    """

    def summed(slot: int, group: list[tuple]) -> list[tuple]:
        told = [unpack_grams(row[5], row[3], level.words, 2) for row in group]
        columns = [np.concatenate(x) for x in zip(*(c for c, _ in told), strict=True)]
        n, lower = (np.concatenate(x) for x in zip(*(t for _, t in told), strict=True))
        history = columns[0]
        for x in columns[1:-1]:
            _, opens, history = np.unique(_pair_keys(history, x), return_index=True, return_inverse=True)
        hot = level.hot.find([x[opens] for x in columns[:-1]])
        _, first, inverse = np.unique(_pair_keys(history, columns[-1]), return_index=True, return_inverse=True)
        count = np.zeros(len(first), np.int64)
        np.add.at(count, inverse, n)
        endings = np.zeros(len(first), np.int64)
        np.maximum.at(endings, inverse, lower)
        seen = count > 0
        own, cs, es = [x[first][seen] for x in columns], count[seen], endings[seen]
        owner = history[first][seen]
        sums = np.zeros((len(opens), 2 * k + 1), np.int64)
        for x, at in ((cs, 0), (es, k)):
            small = x <= k
            np.add.at(sums, (owner[small], x[small] - 1 + at), 1)
        np.add.at(sums[:, 2 * k], owner, es)
        out = [(MODEL, slot, -1, len(cs), 0, pack_grams(own, cs, es))] if keep else []
        out += [(HISTOGRAM, -1, c, m, 0, None) for c, m in enumerate(np.bincount(cs[cs <= k + 1], minlength=1).tolist()) if m]
        out += _heavy(own, cs, heavy)
        for i in np.flatnonzero(hot >= 0).tolist():
            out += [(HOT, int(hot[i]), c, x, 0, None) for c, x in enumerate(sums[i].tolist()) if x]
        at = 0
        for kind, _, block, size, _, _ in group:
            here, past = inverse[at : at + size], history[at : at + size]
            at += size
            if kind == REQUEST:
                starts = _runs(past)
                past, unseen = past[starts], np.logical_or.reduceat(count[here] == 0, starts)
                cold = hot[past] < 0
                of_history = pack(*((x, False) for x in sums[past[cold], :k].T))
                of_endings = pack(*((x, False) for x in sums[past[cold & unseen], k:].T))
                told_of = _two(pack((count[here], False)), _two(of_history, of_endings))
                out.append((level.answer, slot, block, size, int(cold.sum()), told_of))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, group in _grouped(batches, 1):
            yield _table(summed(slot, group))

    return rows.repartition(partitions, "slot").sortWithinPartitions("slot", "kind", "block").mapInArrow(run, ROWS)


def _used(p: np.ndarray) -> np.ndarray:
    """Minus the logarithm of the mass that words of a summed probability leave; to seven digits, also where they take little."""
    return (-np.log1p(-p * GRAIN) / math.log(10)).astype("<f4")


def _two(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _halves(x: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(x[:4], "little")
    return x[4 : 4 + n], x[4 + n :]


@dataclass
class KatzModel:
    """Stored tables of counts with their totals and discounts.

    ``words`` and ``pairs`` are packed rows by slot: (hash, count) of words, (history, word, count) of bigrams by the words'
    numbers. A history's back-off weight is the mass that its discounted bigrams leave over the mass of the words not seen
    after it, both from its own bigrams, which share a slot (those of histories dealt over all slots are summed in ``hot``).
    ``grams`` and ``levels`` go on with 3 and more words: (words, count, count of the ending) of grams.
    """

    words: DataFrame | None
    pairs: DataFrame | None
    unigrams: Unigrams
    pair_slots: int
    discounts: dict[int, float]
    hot: tuple[np.ndarray, np.ndarray]
    k: int
    levels: list[Level] = field(default_factory=list)
    grams: list[DataFrame] = field(default_factory=list)

    def totals(self) -> KatzModel:
        """The model without its tables, as tasks need it."""
        return replace(self, words=None, pairs=None, grams=[], levels=list(self.levels))

    @property
    def order(self) -> int:
        return 2 + len(self.levels)

    @property
    def tokens(self) -> int:
        return self.unigrams.tokens

    @property
    def types(self) -> int:
        return self.unigrams.types

    def history_weights(self, of_count: np.ndarray, total: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What counts are divided by, and the logarithm of the back-off weight, of histories: from how many of their bigrams
        have each discounted count, their own count, and minus the logarithm of the mass of words not seen after them.
        """
        lost = np.zeros(len(total))
        for c in range(1, self.k + 1):
            lost += c * (1 - self.discounts.get(c, 1.0)) * of_count[:, c - 1]
        # where nothing is left for unseen words, one more occurrence of the history makes room
        scale = np.where(lost <= 1e-9, total + 1.0, total)
        return scale, np.log10((scale - total + lost) / scale) + used


def _scores(model: KatzModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    u, k, own = model.unigrams, model.k, model.totals()

    # what is done for a block is done in functions, so that its arrays go before those of the next one come
    def weigh(b: Block, group: list[tuple]) -> None:
        cut = _cut(own.discounts, k)
        hot_sums = own.hot[1]
        hot_scale, hot_back = own.history_weights(hot_sums[:, :k], hot_sums[:, k], _used(hot_sums[:, k + 1]).astype(np.float64))
        b.scale, back = np.ones(len(b.order)), np.zeros(len(b.order))
        for here, m, told in b.answered(group):
            h = b.columns[0][here]
            starts = _runs(h)
            hot = h[starts] < u.hot
            *of_count, used = unpack(told, m, k + 1)
            used = used.astype("<u4").view("<f4").astype(np.float64)
            scale_h, back_h = own.history_weights(np.column_stack(of_count), u.count(h[starts][~hot]), used)
            each, where = np.diff(np.append(starts, len(here))), np.searchsorted(own.hot[0], h[starts][hot])
            scale_of, back_of = np.empty(len(starts)), np.empty(len(starts))
            scale_of[~hot], back_of[~hot] = scale_h, back_h
            scale_of[hot], back_of[hot] = hot_scale[where], hot_back[where]
            b.scale[here], back[here] = np.repeat(scale_of, each), np.repeat(back_of, each)
        p = u.probability(b.columns[1])
        log_p = np.where(p > 0, np.log10(np.where(p > 0, p, 1)), u.log_unknown)
        seen = b.count > 0
        met = np.log10(np.where(seen, b.count * cut[np.minimum(b.count, k + 1)], 1) / b.scale)
        b.value = np.where(seen, met, back + log_p)

    def scored(group: list[tuple]) -> pa.RecordBatch:
        b = Block(group, u, own.pair_slots)
        weigh(b, group)
        # after an unknown history a word stands alone
        c = b.word_count
        p_word = u.p[np.minimum(np.searchsorted(-u.counts, -c), len(u.p) - 1)] if len(u.p) else np.ones(len(c))
        token = np.where(c > 0, np.log10(p_word), u.log_unknown)[b.word]
        # and after a history that is known up to some length, it is scored by the grams of that length
        below, lower, by_order = b, own.discounts, [np.add.reduceat(token, b.starts)]
        token[b.asked] = b.value[b.gram]
        by_order.append(np.add.reduceat(token, b.starts))
        for level in own.levels:
            grams = Grams(b, below, level)
            grams.weigh(grams.answered(group), below, lower, k)
            token[grams.asked] = grams.value[grams.gram]
            by_order.append(np.add.reduceat(token, b.starts))
            below, lower = grams, level.discounts
            del grams
        base = np.log10((c + 0.1) / (u.tokens + 0.1 * (u.types + 1)))[b.word]
        base, known = (np.add.reduceat(x, b.starts) for x in (base, (c > 0).astype(np.int64)[b.word]))
        offsets = np.arange(len(b.ids) + 1, dtype=np.int32) * len(by_order)
        scores = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.column_stack(by_order).ravel()))
        told = (pa.array(b.n_tokens), pa.array(known), pa.array(base), pa.array(by_order[-1]), scores)
        return pa.RecordBatch.from_arrays(
            [pa.array(b.ids, mask=b.nulls.astype(bool)), *told],
            ["id", "n_tokens", "n_known", "base_score", "score", "scores"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _grouped(batches, 2):
            yield scored(group)

    return run


def _flow(docs: DataFrame, params: KatzParams, model: KatzModel | None, keep: bool) -> tuple[KatzModel, DataFrame]:
    """The model, with its tables if they are to be kept, trained on the rows marked so where none is given, and (id, n_tokens, n_known, base_score, score, scores)."""
    spark = docs.sparkSession
    workspace, k = Workspace(spark), params.discounted
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = workspace.store(blocks(docs, params), "blocks", partition_by=["kind"]).select(*_names())
    sizes = {r["kind"]: r["n"] for r in stored.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    # histories of this share of all tokens are dealt over all slots; there are 4000 of them at most
    share = 1 / (2 * min(partitions, 2000))
    slots_for = lambda entries: max(partitions, -(-entries // params.slot))
    slots = model.unigrams.slots if model else slots_for(sizes.get(WORDS, 0))
    asked = _word_requests(stored.filter(F.col("kind") == WORDS), slots)
    summed = _word_slots(asked.unionByName(model.words) if model else asked, partitions, keep)
    by_word = workspace.store(summed, "words", partition_by=["kind"]).select(*_names())
    if model:
        unigrams, pair_slots = model.unigrams, model.pair_slots
    else:
        told = by_word.filter(F.col("kind") == HISTOGRAM).groupBy("block").agg(F.sum("n").alias("n"), F.max("m").alias("m")).collect()
        unigrams = Unigrams.of({r["block"]: r["n"] for r in told}, {r["block"]: r["m"] for r in told}, slots, k, share)
        pair_slots = slots_for(sizes.get(TOKENS, 0))
    heavy = unigrams.tokens * share
    given = model
    last = lambda words: math.inf if given or words == params.order else heavy
    workspace.release()
    answered = stored.unionByName(by_word.filter(F.col("kind") == ANSWER))
    asked = _pair_requests(answered, unigrams, pair_slots, partitions)
    summed = _pair_slots(asked.unionByName(model.pairs) if model else asked, unigrams, k, partitions, last(2), keep)
    by_pair = workspace.store(summed, "pairs", partition_by=["kind"]).select(*_names())
    workspace.release()
    if not given:
        told = by_pair.filter(F.col("kind") == HISTOGRAM).groupBy("block").agg(F.sum("n").alias("n")).collect()
        sums = by_pair.filter(F.col("kind") == HOT).groupBy("slot", "block").agg(F.sum("n").alias("n")).collect()
        names = np.array(sorted({BEGIN} | {r["slot"] for r in sums}), np.int64)
        table = np.zeros((len(names), k + 2), np.int64)
        for r in sums:
            table[np.searchsorted(names, r["slot"]), r["block"]] = r["n"]
        model = KatzModel(
            words=by_word.filter(F.col("kind") == MODEL) if keep else None,
            pairs=by_pair.filter(F.col("kind") == MODEL) if keep else None,
            unigrams=unigrams,
            pair_slots=pair_slots,
            discounts=good_turing({r["block"]: r["n"] for r in told}, k),
            hot=(names, table),
            k=k,
        )
    answered = answered.unionByName(by_pair.filter(F.col("kind") == PAIR_ANSWER))
    below = by_pair
    for words in range(3, (given.order if given else params.order) + 1):
        if given:
            level = given.levels[words - 3]
        else:
            heavies = [unpack_grams(r["payload"], r["n"], words - 1, 0)[0] for r in below.filter(F.col("kind") == HEAVY).collect()]
            columns = [np.concatenate(x) for x in zip(*heavies, strict=True)] or [np.zeros(0, np.int64)] * (words - 1)
            level = Level(words, pair_slots, HotHistories.of(columns, k), {})
        turns = []
        for turn in range(ROUNDS):
            asked = _gram_requests(answered, model, level, partitions, turn)
            if given:
                asked = asked.unionByName(given.grams[words - 3].filter(F.col("slot") % ROUNDS == turn))
            summed = _gram_slots(asked, level, k, partitions, last(words), keep)
            turns.append(workspace.store(summed, f"grams{words}-{turn}", partition_by=["kind"]).select(*_names()))
            workspace.release()
        below = reduce(DataFrame.unionByName, turns)
        if not given:
            told = below.filter(F.col("kind") == HISTOGRAM).groupBy("block").agg(F.sum("n").alias("n")).collect()
            level.discounts = good_turing({r["block"]: r["n"] for r in told}, k)
            for r in below.filter(F.col("kind") == HOT).groupBy("slot", "block").agg(F.sum("n").alias("n")).collect():
                level.hot.sums[r["slot"], r["block"]] = r["n"]
            model.levels.append(level)
            if keep:
                model.grams.append(below.filter(F.col("kind") == MODEL))
        answered = answered.unionByName(below.filter(F.col("kind") == level.answer))
    scored = "id long, n_tokens long, n_known long, base_score double, score double, scores array<double>"
    return model, _at_blocks(answered, partitions).mapInArrow(_scores(model), scored)


def _names() -> list[str]:
    return [c.split()[0] for c in ROWS.split(", ")]


def _rows(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), training.alias("training"))


def train(docs: DataFrame, params: KatzParams = KatzParams(), text_col: str = "text") -> KatzModel:
    """Fits on all rows; null texts are empty, and every text ends with one end token. Other columns are not read.

    Rows repeated count each. Without rows every word is unknown.
    """
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"), F.lit(True).alias("training"))
    return _flow(rows, params, None, True)[0]


def score(
    docs: DataFrame,
    model: KatzModel,
    params: KatzParams = KatzParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score, scores) for every row, with an integer id or none; null texts are empty texts.

    The score of a token is that of its longest gram of up to the model's order of words where the model has it, else the
    weight of backing off from the history plus the score after the history without its first word, and so on down to the
    score of the word alone; unknown words share what discounting leaves, and the weight of a history that is not in the
    training texts is one. Histories begin with the beginning of the text. ``scores`` has the score by grams of up to 1, 2
    and so on words, the last of which is ``score``. Rows repeated are scored each; an empty table gives an empty result; a very long text is
    a block of its own. Other columns are not read.
    """
    if model.words is None:
        raise ValueError("this model's tables were not kept")
    _, scored = _flow(_rows(docs, id_col, text_col, F.lit(False)), params, model, False)
    return scored.withColumnRenamed("id", id_col)


def train_and_score(
    docs: DataFrame,
    training: Column,
    params: KatzParams = KatzParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = True,
) -> tuple[KatzModel, DataFrame]:
    """``train`` on the rows where ``training`` is true and ``score`` of all rows, while texts are read once.

    Without ``keep`` the tables of the model are not written, which has no part in the scores; it then has its totals only.
    """
    model, scored = _flow(_rows(docs, id_col, text_col, training), params, None, keep)
    return model, scored.withColumnRenamed("id", id_col)
