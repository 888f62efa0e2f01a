"""MinHash near-dedup: bottom-k sketches, inverted lists of retained values, union-sketch filter, exact Jaccard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import may_hold, run_filter
from .word_kernels import shingle_sets, slices
from .workspace import Workspace


@dataclass(frozen=True)
class NearDedupParams:
    """``percent``: texts are linked where 100 * intersection >= percent * union of their shingle sets.

    ``k`` values are retained of each set. ``miss`` bounds the chance that the sketches of a linked pair share fewer values
    than asked for. Retained values are ``bits`` wide, so that they take little room in a shuffle; two shingles that share a
    value only add a candidate. ``star_rounds`` bounds how often lists are thinned around one member before all pairs
    that are still apart are compared; it has no part in the result.
    """

    words: int = 5
    percent: int = 80
    k: int = 128
    bits: int = 48
    miss: float = 1e-9
    star_rounds: int = 3

    @property
    def overlap(self) -> int:
        """Values that both sketches retain of the k least of a linked pair's union, but for a chance of ``miss``.

        The k least hashes of a union are a draw without replacement, which varies less than the binomial used here.
        """
        p, total = self.percent / 100, 0.0
        for c in range(self.k + 1):
            total += math.comb(self.k, c) * p**c * (1 - p) ** (self.k - c)
            if total > self.miss:
                return c
        return self.k

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of a sketch's rarest values must be listed so that every linked pair meets in one list.

        A pair that shares c values shares one of the first size - c + 1 of each, in any common order. c for a set of n:
        a union of more than k has at most (1 - t) / t * n values outside the intersection, so at least k minus these
        are shared for certain; a union of at most k is known whole and shares t * n.
        """
        t, size = self.percent / 100, np.minimum(n, self.k)
        large = np.maximum(self.overlap, np.ceil(self.k - (1 - t) / t * n - 1e-9))
        c = np.where(n <= self.k, np.minimum(np.ceil(t * n - 1e-9), large), large)
        return np.maximum(1, size - np.maximum(c, 1) + 1).astype(np.int32)


def sketches(docs: DataFrame, params: NearDedupParams) -> DataFrame:
    """(id, n, key, words, sketch, prefix) from (id, text): set size, digests of the set of shingle hashes and of the words
    themselves, the k least hashes in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in slices(batch.column(1)):
                sizes, keys, texts, kept, ends = [], [], [], [], [0]
                for row, found in enumerate(shingle_sets(data, offsets, params.words)):
                    sizes.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    text = data[offsets[row] : offsets[row + 1]].tobytes()
                    texts.append(hashlib.blake2b(b" ".join(text.lower().split()), digest_size=16).digest())
                    kept.append(np.unique(found.view(np.uint64) >> np.uint64(64 - params.bits))[: params.k].view(np.int64))
                    ends.append(ends[-1] + len(kept[-1]))
                n = np.array(sizes, np.int64)
                sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, rows),
                        pa.array(n),
                        pa.array(keys, pa.binary()),
                        pa.array(texts, pa.binary()),
                        sketch,
                        pa.array(params.prefix(n)),
                    ],
                    ["id", "n", "key", "words", "sketch", "prefix"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, key binary, words binary, sketch array<long>, prefix int")


def inverted_lists(reps: DataFrame) -> DataFrame:
    """(id, n, lone, listed): for each set its rarest retained values, as many as ``prefix`` says; a list has its holders.

    ``lone`` counts the retained values of the set that no other sketch retains.

    The order is by number of sets that retain a value, then by value. A value that only one sketch retains comes first
    but lists nothing, so it only uses up places.
    """
    postings = reps.select("id", F.explode("sketch").alias("value"))
    frequency = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = postings.join(frequency, "value").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared")
    )
    places = F.col("prefix") - (F.size("sketch") - F.size("shared"))
    listed = (
        reps.select("id", "n", "prefix", "sketch")
        .join(shared, "id")
        .filter(places > 0)
        .select(
            "id",
            "n",
            (F.size("sketch") - F.size("shared")).alias("lone"),
            F.transform(F.slice("shared", F.lit(1), places), lambda s: s["value"]).alias("listed"),
        )
    )
    return listed


def _likely(params: NearDedupParams):
    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        """Whether the k least values of the union leave a similarity of ``percent`` possible."""
        k, far = params.k, np.iinfo(np.int64).max
        both = np.full((len(x), 2 * k), far)
        for row, (a, b) in enumerate(zip(x, y, strict=True)):
            both[row, : len(a)] = a
            both[row, k : k + len(b)] = b
        both.sort(axis=1)
        twin = np.zeros(both.shape, bool)
        twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != far)
        real = both != far
        rank = np.cumsum(real & ~twin, axis=1)
        union = np.minimum(rank[:, -1], k)
        shared = (twin & (rank <= k)).sum(axis=1)
        t, sizes = params.percent / 100, (nx + ny).to_numpy()
        whole = (nx.to_numpy() <= k) & (ny.to_numpy() <= k) & (rank[:, -1] <= k)
        # a linked pair has at most (1 - t) / (1 + t) of both sizes outside the intersection
        least = np.maximum(params.overlap, np.ceil(k - (1 - t) / (1 + t) * sizes - 1e-9))
        return pd.Series(np.where(whole, 100 * shared >= params.percent * union, shared >= least))

    return likely


def _verified(params: NearDedupParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, tuple] = {}

        def whole_set(side: str, key, text: str) -> frozenset:
            if side not in last or last[side][0] != key:
                w = (text or "").encode().lower().split()
                m = params.words
                last[side] = key, frozenset(b" ".join(w[i : i + m]) for i in range(max(1, len(w) - m + 1)) if w)
            return last[side][1]

        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            keep = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                p, q = whole_set("a", x, ta[i].as_py()), whole_set("b", y, tb[i].as_py())
                inter = len(p & q)
                if inter and 100 * inter >= params.percent * (len(p) + len(q) - inter):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def texts_of(texts: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """(side, text_side) of the texts (id, text) that column ``side`` of the pairs names, and of few others.

    A filter of the named ids goes to the texts, so texts that no pair asks for do not travel.
    """
    digest = F.unhex(F.md5(F.col("id").cast("string").cast("binary")))
    asked = run_filter(pairs.select(F.col(side).alias("id")).select(digest.alias("digest")))
    found = may_hold(texts.select("id", "text", digest.alias("digest")), asked)
    return found.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))


class _Linker:
    """Finds links between sets until no list holds two sets of different components that were not compared."""

    def __init__(self, texts: DataFrame, reps: DataFrame, params: NearDedupParams, workspace: Workspace):
        self.texts, self.params, self.workspace = texts, params, workspace
        self.reps = reps
        self.held = workspace.store(inverted_lists(reps), "lists")
        workspace.release()
        self.lists = self.held.select("id", "n", "lone", F.explode("listed").alias("value"))

    def components(self) -> DataFrame:
        """(node, component) of sets that are linked to one with a smaller id."""
        stars, done, before = None, False, None
        for step in range(self.params.star_rounds + 1):
            members, mixed, work, size = self._mixed(stars)
            if not work:
                break
            slow = before is not None and work > 0.4 * before
            done, before = step == self.params.star_rounds or slow or work <= 4 * size, work
            pairs = self._all_pairs(members, mixed) if done else self._star_pairs(members, mixed, step)
            links = self._links(pairs, step)
            edges = links if stars is None else links.unionByName(stars.select(F.col("node").alias("a"), F.col("component").alias("b")))
            stars = connected_components(edges, self.workspace, f"stars{step}")
            if done:
                break
        return stars

    def _mixed(self, stars: DataFrame | None):
        """List members with their components, lists with several components, and the pairs to compare in these."""
        if stars is None:
            members = self.lists.withColumn("comp", F.col("id"))
        else:
            members = (
                self.lists.join(stars, F.col("id") == F.col("node"), "left")
                .select("value", "id", "n", "lone", F.coalesce("component", "id").alias("comp"))
            )
        by_component = members.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("c"))
        mixed = (
            by_component.groupBy("value")
            .agg(F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"))
            .filter("parts > 1")
            .select("value", "size", F.col("top.comp").alias("major"), F.col("top.c").alias("major_size"))
        )
        told = mixed.agg(F.sum((F.col("size") - F.col("major_size")) * F.col("size")), F.sum("size")).first()
        return members, mixed, told[0] or 0, told[1] or 0

    def _star_pairs(self, members: DataFrame, mixed: DataFrame, step: int) -> DataFrame:
        """Each set with the list centre that it meets most often; centres change with the step."""
        first = F.col("id") if step == 0 else F.xxhash64("id", F.lit(step))
        rank = F.struct(first.alias("first"), "id", "comp")
        centres = members.join(mixed.select("value"), "value", "left_semi").groupBy("value").agg(F.min(rank).alias("r"))
        centres = centres.select("value", F.col("r.id").alias("centre"), F.col("r.comp").alias("centre_comp"))
        met = members.join(centres, "value").filter("comp <> centre_comp").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("m"))
        best = met.groupBy("id").agg(F.max(F.struct(F.col("m"), -F.col("centre").cast("long"), "centre")).alias("b"))
        return best.select(F.col("id").alias("a"), F.col("b.centre").alias("b"))

    def _all_pairs(self, members: DataFrame, mixed: DataFrame) -> DataFrame:
        """Likely pairs of one list but different components, each once; at most one of a pair is in the list's main part.

        The cheap tests come first: sizes, then lone values (of whole sets, an intersection holds no lone value and a
        union holds all of both). A pair counts only in the first list that it meets in, and only where the k least values
        of its union allow a link, so a list of sets that are alike, but not alike enough, puts out next to nothing.
        """
        t, k, least = self.params.percent, self.params.k, self.params.overlap
        sides = self.reps.select("id", "sketch").join(self.held.select("id", "listed"), "id")
        here = (
            members.join(mixed.select("value", "major"), "value")
            .join(sides, "id")
            .select("value", "id", "n", "lone", "comp", "major", "sketch", "listed")
        )
        minor = here.filter("comp <> major").select(
            "value", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "lone", "comp", "sketch", "listed"))
        )
        common, common_x = F.col("n") - F.col("lone"), F.col("n_x") - F.col("lone_x")
        whole = F.greatest("n", "n_x") <= k
        possible = F.least(common, common_x) * 100 >= (F.greatest(common, common_x) + F.col("lone") + F.col("lone_x")) * t
        first_met = F.get(F.array_intersect("listed", "listed_x"), F.lit(0)) == F.col("value")
        shared = F.array_intersect("sketch", "sketch_x")
        least_of_both = F.slice(F.sort_array(F.array_union("sketch", "sketch_x")), 1, k)
        among_least = F.size(F.array_intersect(shared, least_of_both))
        # of whole sets t / (1 + t) of both sizes; else at most (1 - t) / (1 + t) of both sizes is outside
        needed = F.when(whole, (F.col("n") + F.col("n_x")) * t / (100 + t)).otherwise(
            F.greatest(F.lit(least), k - (F.col("n") + F.col("n_x")) * (100 - t) / (100 + t))
        )
        pairs = minor.join(here, "value").filter(
            (F.col("comp_x") != F.col("comp"))
            & ((F.col("comp") == F.col("major")) | (F.col("id_x") < F.col("id")))
            & (F.col("n_x") * 100 >= F.col("n") * t)
            & (F.col("n") * 100 >= F.col("n_x") * t)
            & (~whole | possible)
            & first_met
            & (F.size(shared) >= needed - 1e-6)
            & (whole | (among_least >= needed - 1e-6))
        )
        return pairs.select(F.least("id_x", "id").alias("a"), F.greatest("id_x", "id").alias("b")).distinct()

    def _links(self, pairs: DataFrame, step: int) -> DataFrame:
        side = self.reps.select("id", "n", "sketch")
        a, b = (side.select(*(F.col(c).alias(f"{c}_{s}") for c in side.columns)) for s in "ab")
        likely = _likely(self.params)
        joined = pairs.join(b, F.col("b") == F.col("id_b")).join(a, F.col("a") == F.col("id_a"))
        likely_pairs = joined.filter(likely("sketch_a", "sketch_b", "n_a", "n_b")).select("a", "b")
        likely_pairs = self.workspace.store(likely_pairs, f"likely{step}")
        self.workspace.release()
        texts_a, texts_b = (texts_of(self.texts, likely_pairs, s) for s in "ab")
        whole = likely_pairs.join(texts_a, "a").join(texts_b, "b").select("a", "b", "text_a", "text_b")
        kind = pairs.schema["a"].dataType.simpleString()
        links = whole.mapInArrow(_verified(self.params), f"a {kind}, b {kind}")
        links = self.workspace.store(links, f"links{step}")
        self.workspace.drop(f"likely{step}")
        self.workspace.release()
        return links


def confirmed_classes(found: DataFrame, texts: DataFrame, params: NearDedupParams, workspace: Workspace) -> DataFrame:
    """``found`` without ``words``; ``key`` is changed where the set of words is not that of the class's least id.

    Rows of one sequence of words have one set. The first row of each other sequence in a class is compared with the
    first row of the class on the words; should only their hashes agree, the sequence becomes a class of its own.
    """
    of_words = found.filter("n > 0 and id is not null").groupBy("key", "words").agg(F.min("id").alias("a"))
    of_words = workspace.store(of_words, "sequences")
    classes = of_words.groupBy("key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    apart = workspace.store(of_words.join(classes, "key").filter("a <> b").select("a", "b", "key", "words"), "apart")
    text_a, text_b = (texts_of(texts, apart, s) for s in "ab")
    pairs = apart.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")
    equal = pairs.mapInArrow(_verified(replace(params, percent=100)), "a long, b long")
    wrong = workspace.store(apart.join(equal, "a", "left_anti").select("key", "words"), "wrong")
    workspace.drop("sequences", "apart")
    if wrong.isEmpty():
        return found.drop("words")
    own = found.join(wrong.withColumn("wrong", F.lit(True)), ["key", "words"], "left")
    return own.withColumn("key", F.when(F.col("wrong"), F.concat("key", "words")).otherwise(F.col("key"))).drop("wrong", "words")


def near_dedup(
    docs: DataFrame, params: NearDedupParams = NearDedupParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row; identifiers are integers.

    Texts are words between white space, A-Z lower-cased; a text of fewer words than a shingle has one shingle. Equal sets,
    compared on their words, are one class under the smallest id; classes meet in inverted lists of their rarest retained values, pairs pass the
    union-sketch filter and are confirmed on the whole sets of words. The component is the smallest id reachable over
    links; one row of each stays. Texts without words and null texts link with nothing. Rows with a null id link with
    nothing, have a null component and stay. Rows repeated with one id are one node. Other columns are not read.
    Of a component the row with the smallest id stays, so there are no ties; long texts are taken whole, their sets without a
    bound; an empty table gives an empty result.
    """
    workspace = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = workspace.store(sketches(rows, params), "sketches")
    found = confirmed_classes(found, rows, params, workspace)
    classes = found.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"))
    classes = workspace.store(classes, "classes")
    reps = found.join(classes.withColumnRenamed("rep", "id"), ["id", "key"]).dropDuplicates(["id", "key"])
    reps = workspace.store(reps.select("id", "n", "sketch", "prefix"), "reps")
    found = workspace.store(found.select("id", "n", "key"), "keys")
    workspace.drop("sketches")
    workspace.release()
    linker = _Linker(rows, reps, params, workspace)
    stars = linker.components()
    if stars is not None:
        classes = classes.join(stars, F.col("rep") == F.col("node"), "left").select(
            "key", F.coalesce("component", "rep").alias("rep")
        )
    placed = found.select("id", "n", "key").join(classes, "key", "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id"))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
