"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Language of texts without a letter.
UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdParams:
    """``rows_per_language`` and ``chars_per_language`` bound the labelled rows that a model is fitted on, and their length
    altogether, as expected of a draw by a hash of the identifier.

    A word is known if it stands ``min_count`` times in the sample. Unseen words are scored by the longest of
    their n-grams, from ``max_gram`` letters down to one, that the model has; every language has a share of ``floor``
    occurrences in each entry.
    """

    rows_per_language: int = 3000
    chars_per_language: int = 50_000_000
    min_count: int = 3
    max_gram: int = 4
    floor: float = 0.5


def letters(texts: pa.Array) -> pa.Array:
    """Lists of lower-case words, runs of letters, of each text; null for texts without one."""
    lowered = pc.utf8_lower(texts)
    spaced = pc.replace_substring_regex(lowered, r"\P{L}+", " ")
    trimmed = pc.utf8_trim_whitespace(spaced)
    return pc.utf8_split_whitespace(pc.if_else(pc.equal(trimmed, ""), None, trimmed))


def _distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the code of every word, and the offsets of the texts in the codes."""
    split = letters(texts)
    flat = pc.fill_null(split.flatten(), "")
    coded = flat.dictionary_encode()
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)])


class BackoffModel:
    """Log frequencies per language of words and of n-grams of word types."""

    def __init__(self, languages: list[str], words: pa.Array, word_logs: np.ndarray, gram_logs: dict[str, np.ndarray], max_gram: int):
        self.languages, self.words, self.word_logs = languages, words, word_logs
        self.gram_logs, self.max_gram = gram_logs, max_gram
        self._nothing = np.zeros(len(languages))

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the word's places of the longest known n-gram that begins there."""
        padded, total, n = f"^{word}$", self._nothing.copy(), 0
        for at in range(len(padded) - 1):
            for size in range(min(self.max_gram, len(padded) - at), 0, -1):
                got = self.gram_logs.get(padded[at : at + size])
                if got is not None:
                    total += got
                    n += 1
                    break
        return total / n if n else total

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Best language (number, -1 for none) and its share of the posterior, for each text."""
        distinct, codes, ends = _distinct_words(texts)
        known = pc.index_in(distinct, self.words)
        place = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
        logs = np.empty((len(distinct), len(self.languages)))
        logs[place >= 0] = self.word_logs[place[place >= 0]]
        unseen = np.flatnonzero(place < 0)
        for i, word in zip(unseen.tolist(), distinct.take(pa.array(unseen)).to_pylist(), strict=True):
            logs[i] = self.unseen(word)
        sums = np.zeros((len(codes) + 1, len(self.languages)))
        if len(codes):
            np.cumsum(logs[codes], axis=0, out=sums[1:])
        total, n = sums[ends[1:]] - sums[ends[:-1]], np.diff(ends)
        best = np.where(n > 0, total.argmax(axis=1), -1)
        # words are not independent: the mean over the root of their number keeps the share below 1 for short texts
        scaled = total / np.sqrt(np.maximum(n, 1))[:, None]
        share = np.exp(scaled - scaled.max(axis=1, keepdims=True))
        return best, share.max(axis=1) / share.sum(axis=1)


def fit(training: DataFrame, params: LangIdParams = LangIdParams()) -> BackoffModel | None:
    """Fits on (id, text, lang); null texts and languages are left out. None where nothing is left.

    Any string is a language, the empty one too. The model is bounded by the sample: the rows drawn of each language and
    their words. Rows repeated count each; other columns are not read.
    """
    drawn = training.filter("text is not null and lang is not null")
    length = F.char_length("text").cast("long")
    told = drawn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("chars")).collect()
    languages = sorted(r["lang"] for r in told)
    if not languages:
        return None
    # a share of each language by hash, with a margin, is one scan without a sort; rows beyond the bound don't matter
    shares = {r["lang"]: min(1.0, params.rows_per_language / r["n"], params.chars_per_language / max(1, r["chars"])) for r in told}
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(shares[k]))))
    number = F.create_map(*(x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))))
    dice = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    sample = drawn.filter(dice < share[F.col("lang")]).select(number[F.col("lang")].alias("language"), "text")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = letters(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pc.list_parent_indices(split)), split.flatten()], ["language", "word"]
            )

    words = sample.mapInArrow(words_of, "language int, word string")
    counted = words.groupBy("word", "language").agg(F.count(F.lit(1)).alias("n"))
    by_word = counted.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("language", "n")).alias("of"))
    table = by_word.filter(F.col("n") >= params.min_count).select("word", "of").toArrow()
    known = table.column("word").combine_chunks()
    lists = table.column("of").combine_chunks()
    word_counts = np.zeros((len(known), len(languages)))
    entries = lists.flatten()
    word_counts[pc.list_parent_indices(lists).to_numpy(), entries.field("language").to_numpy()] = entries.field("n").to_numpy()

    grams: list[dict[str, float]] = [defaultdict(float) for _ in languages]
    weights = np.log1p(word_counts)  # frequent words must not stand for how words are spelt
    words_list = known.to_pylist()
    for k, own in enumerate(grams):
        for i in np.flatnonzero(word_counts[:, k]).tolist():
            padded, weight = f"^{words_list[i]}$", float(weights[i, k])
            for size in range(1, params.max_gram + 1):
                for at in range(len(padded) - size + 1):
                    own[padded[at : at + size]] += weight
    sizes = np.zeros((params.max_gram + 1, len(languages)))
    for k, own in enumerate(grams):
        for gram, weight in own.items():
            sizes[len(gram), k] += weight
    floor = params.floor
    gram_logs = {
        g: np.log(np.array([own.get(g, 0.0) for own in grams]) + floor) - np.log(sizes[len(g)] + 1)
        for g in set().union(*grams)
    }
    word_logs = np.log(word_counts + floor) - np.log(word_counts.sum(axis=0) + 1)
    return BackoffModel(languages, known, word_logs, gram_logs, params.max_gram)


def identify(docs: DataFrame, model: BackoffModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row from its whole text alone.

    Null texts, texts without a letter and any text without a model are ``und`` with score 0. Ties go to the language
    first by name. Long texts are scored whole, a thousand rows at a time; rows repeated are answered alike; an empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        names = pa.array([*(found.languages if found else []), UNDETERMINED])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if found is None:
                    best, score = np.full(part.num_rows, -1), np.zeros(part.num_rows)
                else:
                    best, score = found.score(pc.fill_null(part.column(1), ""))
                picked = pa.array(np.where(best < 0, len(names) - 1, best))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), names.take(picked), pa.array(np.where(best < 0, 0.0, score))], ["id", "lang_pred", "score"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)

