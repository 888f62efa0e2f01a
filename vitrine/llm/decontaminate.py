"""Benchmark decontamination with a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: What stands between words once A-Z are lower-cased; a fixed pattern.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same where A-Z are as they were.
SEPARATORS_AS_WRITTEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of a text among which two postings can meet.
STRETCH = 64


def _split(text: Column, at: str = SEPARATORS) -> Column:
    return F.array_remove(F.split(text, at), "")


def exact_words(text: Column) -> Column:
    """Words with A-Z lower-cased, and nothing else."""
    return _split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def index_words(text: Column) -> Column:
    """Words with all letters lower-cased one by one, at the same places as ``exact_words``: what is equal there is equal here.

    Only candidates come from these.
    """
    return F.transform(_split(text, SEPARATORS_AS_WRITTEN), F.lower)


def benchmark_items(benchmark: DataFrame, id_col: str, text_col: str, window: int, misses: int) -> DataFrame:
    """(item_id, words, terms, width, misses) of items that have words; equal rows count once."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return (
        items.select("item_id", exact_words(F.col("text")).alias("words"), index_words(F.col("text")).alias("terms"))
        .filter(F.size("words") > 0)
        .withColumn("width", F.least(F.size("words"), F.lit(window)))
        .withColumn("misses", F.when(F.col("width") == window, misses).otherwise(0))
    )


def positional_index(docs: DataFrame, vocabulary: DataFrame, workspace: Workspace) -> DataFrame:
    """Stored postings (term, id, pos) of the vocabulary's terms in the documents (id, text).

    The vocabulary is that of the test set; how it meets the words is left to the planner, which sends it to all
    executors only where its size is below the session's threshold.
    """
    tokens = docs.select("id", F.posexplode(_split(F.col("text"), SEPARATORS_AS_WRITTEN)).alias("pos", "word"))
    tokens = tokens.withColumn("word", F.lower("word"))
    postings = tokens.join(vocabulary.select(F.col("word"), F.col("term")), "word").select("term", "id", "pos")
    return workspace.store(postings, "postings")


def rarest_terms(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(term, item_id, at): for every window of every item the place of its rarest term, each place once.

    Terms that no document holds are rarest of all; a window with such a term can't occur, so it has no place here.
    """
    at = items.select("item_id", "width", F.size("terms").alias("n"), F.posexplode("terms").alias("at", "word"))
    known = at.join(frequency, "word", "left").select(
        "item_id", "width", "n", "at", "term", F.coalesce("df", F.lit(0)).alias("df")
    )
    starts = F.explode(
        F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("width") + 1), F.least(F.col("at"), F.col("n") - F.col("width")))
    )
    least = known.select("item_id", starts.alias("start"), "df", "at", "term").groupBy("item_id", "start").agg(
        F.min(F.struct("df", "at", "term")).alias("r")
    )
    return least.filter("r.df > 0").select(F.col("r.term").alias("term"), "item_id", F.col("r.at").alias("at")).distinct()


def rarest_pairs(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(pair, term, term2, item_id, at, gap, begins, piece): for every piece of every item the places of its two rarest terms.

    A window with m misses is cut into m + 1 pieces, of which one at least has all its words; so all runs of that length are
    pieces here. Runs with a term that no document holds have no place. ``begins`` are the runs that share two places.
    """
    piece = F.floor(F.col("width") / (F.col("misses") + 1)).cast("int")
    text = F.xxhash64("words").alias("text")
    at = items.select("item_id", text, piece.alias("piece"), F.size("terms").alias("n"), F.posexplode("terms").alias("at", "word"))
    known = at.join(frequency, "word").select("item_id", "text", "piece", "n", F.struct("df", "at", "term").alias("place"))
    begin = F.explode(
        F.sequence(
            F.greatest(F.lit(0), F.col("place.at") - F.col("piece") + 1),
            F.least(F.col("place.at"), F.col("n") - F.col("piece")),
        )
    )
    runs = known.select("item_id", "text", "piece", "place", begin.alias("begin")).groupBy("item_id", "text", "piece", "begin").agg(
        F.array_sort(F.collect_list("place")).alias("places")
    )
    one, two = F.col("places")[0], F.coalesce(F.get("places", F.lit(1)), F.col("places")[0])
    return (
        runs.filter(F.size("places") == F.col("piece"))
        .select(
            "item_id",
            "piece",
            "begin",
            one["term"].alias("term"),
            two["term"].alias("term2"),
            one["at"].alias("at"),
            (two["at"] - one["at"]).alias("gap"),
        )
        .groupBy("term", "term2", "item_id", "at", "gap", "piece")
        .agg(F.collect_list("begin").alias("begins"))
        .withColumn("pair", F.monotonically_increasing_id())
    )


def near_shifts(postings: DataFrame, pairs: DataFrame, slack: int) -> DataFrame:
    """Distinct (id, pair, shift) where the postings of both terms of a pair, less their places, are within 2 * slack.

    Places meet in stretches of a text, so one that repeats a term is not compared with itself place by place.
    """
    wide = max(STRETCH, 4 * slack + 1)
    low = F.col("pos") + F.col("gap") - 2 * slack
    first = postings.join(pairs.select("term", "term2", "pair", "gap"), "term").select(
        "id",
        F.col("term2").alias("term"),
        "pair",
        F.col("pos").alias("pos1"),
        F.explode(F.array_distinct(F.array(F.floor(low / wide), F.floor((low + 4 * slack) / wide)))).alias("stretch"),
    )
    second = postings.join(pairs.select(F.col("term2").alias("term")).distinct(), "term", "left_semi")
    second = second.withColumn("stretch", F.floor(F.col("pos") / wide))
    # postings travel without what the pair tells
    met = first.join(second, ["id", "term", "stretch"]).join(pairs.select("pair", "at", "gap"), "pair")
    met = met.filter(F.abs(F.col("pos") - F.col("pos1") - F.col("gap")) <= 2 * slack)
    return met.select("id", "pair", (F.col("pos1") - F.col("at")).alias("shift")).distinct()


def near_match(words: Column, laid: Column, at: Column, slack: int) -> Column:
    """Whether a window of the item lies near a shift within ``slack`` of the candidate's: all its words but ``misses`` at
    most stand within ``slack`` of their places there. Of the candidate's pieces one must have all its words first.
    """
    item, n = laid["item"], F.size(laid["item"])

    def stands(i: Column, shift: Column, by: int) -> Column:
        out = F.lit(False)
        for d in range(-by, by + 1):
            out = out | F.coalesce(F.get(words, shift + i + d) == F.get(item, i), F.lit(False))
        return out

    whole = F.exists(
        at["begins"],
        lambda b: F.forall(F.sequence(b, b + at["piece"] - 1), lambda i: stands(i, at["shift"], 2 * slack)),
    )
    missed = F.transform(
        F.sequence(F.lit(-slack), F.lit(slack)),
        lambda e: F.concat(
            F.array(F.lit(-1)),
            F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~stands(i, at["shift"] + e, slack)),
            F.array(n),
        ),
    )
    # a window with few misses lies between two missed places that have these misses between them
    step = laid["misses"] + 1
    wide = lambda m: (F.size(m) - 1 <= step) | F.exists(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(m) - 1 - step)),
        lambda j: F.coalesce(F.get(m, j + step) - F.get(m, j) - 1 >= laid["width"], F.lit(False)),
    )
    return F.when(whole, F.exists(missed, wide)).otherwise(F.lit(False))


def occurrences(words: Column, item: Column, shift: Column, width: Column) -> Column:
    """Stretches (first, last) of the document inside windows of an item that occur when the item is laid at ``shift``.

    They lie between places that differ, wherever a window has room there.
    """
    first = F.greatest(F.lit(0), -shift)
    last = F.least(F.size(item), F.size(words) - shift) - 1
    differ = F.filter(F.sequence(first, last), lambda i: ~F.coalesce(F.get(words, shift + i) == F.get(item, i), F.lit(False)))
    bounds = F.concat(F.array(first - 1), differ, F.array(last + 1))

    def between(b: Column) -> Column:
        stretches = F.transform(
            F.sequence(F.lit(0), F.size(b) - 2),
            lambda j: F.struct((F.get(b, j) + 1 + shift).alias("first"), (F.get(b, j + 1) - 1 + shift).alias("last")),
        )
        return F.filter(stretches, lambda s: s["last"] - s["first"] + 1 >= width)

    none = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    return F.when(last - first + 1 >= width, _let(bounds, between)).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered(stretches: Column) -> Column:
    """Sorted distinct places inside any stretch; what the stretch before covers is not listed again."""
    none = F.expr("cast(array() as array<int>)")

    def places(ordered: Column) -> Column:
        def fresh(s: Column, i: Column) -> Column:
            begin = F.greatest(s["first"], F.coalesce(F.get(ordered, i - 1)["last"] + 1, F.lit(0)))
            return F.when(begin <= s["last"], F.sequence(begin, s["last"])).otherwise(none)

        return F.array_sort(F.array_distinct(F.flatten(F.transform(ordered, fresh))))

    return F.coalesce(_let(F.array_sort(F.array_distinct(stretches)), places), none)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    slack: int = 1,
    misses: int = 1,
) -> DataFrame:
    """(id_col, n_words, hits, items, near) for every row: occurrences of benchmark windows in whole documents.

    A window is ``window`` consecutive words of an item, or all words of a shorter item that has any. ``hits`` lists the
    places (from 0) of words inside any occurrence, ``items`` the identifiers of the items that occur. Null texts have
    no words; null item texts have no windows. Rows repeated with one id are each looked at on their own: a candidate of
    one is only a candidate of the other. A null id is answered with no hits where its text has none; ids are expected
    for documents that are to be searched. Other columns are not read. An empty table gives an empty result, no items
    give no hits; of equally rare terms the first in a window is looked up. Long texts are searched whole: a document's
    words, and its candidates, are one row. A text that repeats a word takes time by its length times that of the items
    that hold it.

    ``near`` lists the items with a proximity match, exact ones included: there is a shift such that all words of a window
    but ``misses`` (fewer than ``window``; none in items of fewer than ``window`` words) stand within ``slack`` of their
    places. So a word changed, put in or left out of a window of full width makes no difference to it. Candidates are the
    places where the postings of the two rarest terms of a piece of a window agree.

    Each window is looked up by its rarest term in the positional index; a posting minus the term's place in the item is
    the shift at which the item would lie, and the other places of the item must agree at that shift.
    """
    workspace = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    items = workspace.store(benchmark_items(benchmark, item_id_col, item_text_col, window, misses), "items")
    distinct = items.select(F.explode("terms").alias("word")).distinct().withColumn("term", F.monotonically_increasing_id())
    vocabulary = workspace.store(distinct, "vocabulary")
    postings = positional_index(rows, vocabulary, workspace)
    frequency = vocabulary.join(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    seeds = workspace.store(rarest_terms(items, frequency), "seeds")
    shifts = (
        postings.join(seeds, "term")
        .select("id", "item_id", (F.col("pos") - F.col("at")).alias("shift"))
        .distinct()
    )
    pairs = workspace.store(rarest_pairs(items, frequency), "pairs")
    workspace.release()
    nearby = workspace.store(near_shifts(postings, pairs, slack), "nearby")
    workspace.release()
    nearby = nearby.join(pairs.select("pair", "item_id", "begins", "piece"), "pair")
    exact = shifts.withColumn("begins", F.lit(None).cast("array<int>")).withColumn("piece", F.lit(None).cast("int"))
    shifts = exact.unionByName(nearby.drop("pair"))
    # an item's words come once for all its shifts
    by_item = shifts.groupBy("id", "item_id").agg(F.collect_list(F.struct("shift", "begins", "piece")).alias("at"))
    laid = F.struct("item_id", F.col("words").alias("item"), "width", "misses", "at")
    candidates = by_item.join(items.select("item_id", "words", "width", "misses"), "item_id").groupBy("id").agg(
        F.collect_list(laid).alias("laid")
    )
    candidates = workspace.store(candidates, "candidates")
    workspace.drop("postings", "nearby")
    workspace.release()

    # rows with candidates are worked out and stored apart: a filter on hits must not be pushed into the comparisons,
    # where the words of a text would be made anew for each of them
    page = F.xxhash64("text")
    joined = rows.join(candidates, "id").select("id", page.alias("page"), "laid", exact_words(F.col("text")).alias("doc_words"))
    found = F.filter(
        F.transform(
            "laid",
            lambda c: F.struct(
                c["item_id"].alias("item_id"),
                F.flatten(
                    F.transform(
                        F.filter(c["at"], lambda a: a["begins"].isNull()),
                        lambda a: occurrences(F.col("doc_words"), c["item"], a["shift"], c["width"]),
                    )
                ).alias("stretches"),
            ),
        ),
        lambda c: F.size(c["stretches"]) > 0,
    )
    by_pairs = F.filter(
        "laid",
        lambda c: F.exists(c["at"], lambda a: a["begins"].isNotNull() & near_match(F.col("doc_words"), c, a, slack)),
    )
    item_kind = items.schema["item_id"].dataType.simpleString()
    searched = joined.select("id", "page", found.alias("found"), by_pairs.alias("by_pairs")).select(
        "id",
        "page",
        covered(F.flatten(F.transform("found", lambda c: c["stretches"]))).alias("hits"),
        F.array_distinct(F.transform("found", lambda c: c["item_id"])).alias("items"),
        F.array_distinct(F.transform("by_pairs", lambda c: c["item_id"])).alias("near"),
    )
    searched = workspace.store(searched, "searched").dropDuplicates(["id", "page"])
    return (
        rows.select("id", page.alias("page"), _count_words(F.col("text")).alias("n_words"))
        .join(searched, ["id", "page"], "left")
        .select(
            F.col("id").alias(id_col),
            "n_words",
            F.coalesce("hits", F.expr("cast(array() as array<int>)")).alias("hits"),
            F.coalesce("items", F.expr(f"cast(array() as array<{item_kind}>)")).alias("items"),
            F.coalesce("near", F.expr(f"cast(array() as array<{item_kind}>)")).alias("near"),
        )
    )


def _count_words(text: Column) -> Column:
    """Number of words; case makes no difference to it, so A-Z are left as they are."""
    return F.size(_split(text, SEPARATORS_AS_WRITTEN)).cast("long")
