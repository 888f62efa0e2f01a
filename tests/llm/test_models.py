import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from vitrine.llm import langid, lm_score, quality
from vitrine.llm.queries import QUERIES


def split(text):
    return [*(text or "").encode().lower().split(), b"</s> "]


def katz(train, texts, least=1, k=5):
    """Token by token."""
    words, pairs = Counter(), Counter()
    for t in train:
        w = split(t)
        words.update(w)
        pairs.update(zip([b"<s> ", *w[:-1]], w, strict=True))
    total = sum(words.values())
    dw, dp = (lm_score.good_turing(Counter(c.values()), k) for c in (words, pairs))
    p = {w: c * dw.get(c, 1.0) / total for w, c in words.items()}
    unknown = 1 - sum(p.values())
    shrink = 1.0
    if unknown <= 1e-12:
        shrink = total / (total + 1)
        p = {w: x * shrink for w, x in p.items()}
        unknown = 1 - sum(p.values())
    mass, below = defaultdict(float), defaultdict(float)
    for (h, w), c in pairs.items():
        if c >= least:
            mass[h] += c * dp.get(c, 1.0)
            below[h] += p[w]
    seen = lambda h: len(train) if h == b"<s> " else words[h]
    scale = {h: seen(h) + (mass[h] >= seen(h) - 1e-9) for h in mass}
    back = {h: (1 - mass[h] / scale[h]) / (1 - below[h]) for h in mass}

    def prob(h, w):
        c = pairs.get((h, w), 0)
        return c * dp.get(c, 1.0) / scale[h] if c >= least else back.get(h, 1.0) * p.get(w, unknown)

    for h in [*list(mass)[:20], b"never seen"]:  # exactly normalised over known words and the unknown one
        assert math.isclose(sum(prob(h, w) for w in words) + prob(h, b"unknown word"), 1, rel_tol=1e-9)
    out = []
    for t in texts:
        w = split(t)
        base = sum(math.log10((words[x] + 0.1) / (total + 0.1 * (len(words) + 1))) for x in w)
        out.append((len(w), sum(words[x] > 0 for x in w), base, sum(math.log10(prob(h, x)) for h, x in zip([b"<s> ", *w[:-1]], w, strict=True))))
    return total, out


TRAIN = ["a b a b c", "a b a c d e f g", None, "", "A B x y z a b", "the end of the end", "b a b a b", "q r s t u v w"]


@pytest.mark.parametrize("flush, slot", [(20, 5), (4_000_000, 1_000_000)])
@pytest.mark.parametrize("times", [1, 2])
def test_katz_matches_token_by_token(documents, flush, slot, times):
    train = TRAIN * times + ["the end is not seen twice"]
    texts = [*train, "unknown words a b", "é É", "x " * 3000, "q r a", "a b unknown a", "a"]
    params = lm_score.KatzParams(flush=flush, slot=slot)
    model = lm_score.train(documents(train), params)
    total, want = katz(train, texts)
    assert model.tokens == total
    apart = lm_score.score(documents(texts), model, params).collect()
    together = lm_score.train_and_score(documents(texts), F.col("doc_id") < len(train), params)[1].collect()
    for rows in (apart, together):
        got = {r["doc_id"]: r for r in rows}
        assert len(got) == len(texts)
        for i, (n, known, base, score) in enumerate(want):
            assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)
            assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-7)


def test_katz_rows_without_id_and_repeated_rows(documents):
    docs = documents(["a b", "a b", "c", None], ids=[None, 5, 5, 5])
    rows = lm_score.train_and_score(docs, F.lit(True))[1].collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == [("5", 1), ("5", 2), ("5", 3), ("None", 3)]


def test_words_of_one_pattern_are_not_mixed_up(documents):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    model = lm_score.train(documents([word, word]))
    rows = lm_score.score(documents([word, other]), model).collect()
    assert {r["doc_id"]: r["n_known"] for r in rows} == {0: 2, 1: 1}


def test_packed_arrays_come_back():
    h = np.array([1, 1, 5, 5, 5, 1 << 40], np.int64)
    w, n = np.array([0, 7, 2, 3, 1 << 50, 4], np.int64), np.array([1, 0, 300, 1 << 33, 2, 9], np.int64)
    assert all((a == b).all() for a, b in zip(lm_score.unpack_pairs(lm_score.pack_pairs(h, w, n), 6), (h, w, n), strict=True))
    keys = lm_score._pair_keys(h << 20, w)
    assert len(set(keys.tolist())) == 6 and (np.diff(keys) > 0).all()
    wild = np.array([5, -3, 1 << 62], np.int64)
    assert (lm_score.unpack(lm_score.pack((wild, False)), 3, 1)[0] == wild).all()


def test_katz_query_has_all_bigrams(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
    _, want = katz([r["text"] for r in rows if not held(r)], [r["text"] for r in rows])
    got = {r["doc_id"]: r["score"] for r in QUERIES["op8_katz_lm_score"](spark, SMALL).collect()}
    assert [got[r["doc_id"]] for r in rows] == pytest.approx([w[3] for w in want], abs=1e-3)


def katz_of_order(train, texts, order, k=5):
    """Scores by grams of up to 1, 2, ... words, gram by gram."""
    grams = [Counter() for _ in range(order + 1)]
    padded = lambda t: [b"<s> ", *split(t)]
    for t in train:
        w = padded(t)
        for m in range(1, order + 1):
            grams[m].update(tuple(w[i : i + m]) for i in range(m == 1, len(w) - m + 1))
    total = sum(grams[1].values())
    cut = [None, *(lm_score.good_turing(Counter(c.values()), k) for c in grams[1:])]
    p1 = {g: c * cut[1].get(c, 1.0) / total for g, c in grams[1].items()}
    if 1 - sum(p1.values()) <= 1e-12:
        p1 = {g: x * total / (total + 1) for g, x in p1.items()}
    unknown = 1 - sum(p1.values())
    after = defaultdict(Counter)
    for m in range(2, order + 1):
        for g, c in grams[m].items():
            after[g[:-1]][g[-1]] = c
    known = {}

    def prob(h, w):
        if (h, w) in known:
            return known[h, w]
        if not h:
            return p1.get((w,), unknown)
        found, d = after.get(h), cut[len(h) + 1]
        if not found:
            return prob(h[1:], w)
        all_of, mass = sum(found.values()), sum(c * d.get(c, 1.0) for c in found.values())
        scale = all_of + (mass >= all_of - 1e-9)
        if w in found:
            out = found[w] * d.get(found[w], 1.0) / scale
        else:
            out = (1 - mass / scale) / (1 - sum(prob(h[1:], x) for x in found)) * prob(h[1:], w)
        known[h, w] = out
        return out

    for h in [h for h in after if len(h) == order - 1][:20]:  # exactly normalised over known words and the unknown one
        assert math.isclose(sum(prob(h, w) for (w,) in grams[1]) + prob(h, b"unknown word"), 1, rel_tol=1e-9)
    out = []
    for t in texts:
        w = padded(t)
        out.append([sum(math.log10(prob(tuple(w[max(0, i - m + 1) : i]), w[i])) for i in range(1, len(w))) for m in range(1, order + 1)])
    return out


@pytest.mark.parametrize("order, flush, slot", [(3, 60, 30), (4, 4_000_000, 1_000_000)])
def test_katz_backs_off_through_all_orders(documents, order, flush, slot):
    train = [*TRAIN, *TRAIN, "the end is not seen twice", "a b a c", "x y z x y z x y", "b a b a c d"]
    texts = [*train, "unknown words a b a", "é É", "x " * 300, "q r a b a d", "a b unknown a b a c", "a", "the end of it", "y z x y q"]
    params = lm_score.KatzParams(flush=flush, slot=slot, order=order)
    model = lm_score.train(documents(train), params)
    assert model.order == order
    want = katz_of_order(train, texts, order)
    apart = lm_score.score(documents(texts), model, params).collect()
    together = lm_score.train_and_score(documents(texts), F.col("doc_id") < len(train), params)[1].collect()
    for rows in (apart, together):
        got = {r["doc_id"]: r for r in rows}
        assert len(got) == len(texts) and all(r["score"] == r["scores"][-1] for r in rows)
        for i, scores in enumerate(want):
            assert got[i]["scores"] == pytest.approx(scores, rel=1e-6)


def test_katz_trigrams_after_hot_histories(documents):
    train = ["of the a of the b of the c of the d", "of the a of the e", "by the a of the f", "of the", "the the the the of the a"] * 2
    texts = [*train, "of the g of the a", "by the b", "the the the a", None]
    params = lm_score.KatzParams(flush=10, order=3)
    model, scored = lm_score.train_and_score(documents(texts), F.col("doc_id") < len(train), params, keep=False)
    got = {r["doc_id"]: r["scores"] for r in scored.collect()}
    assert len(model.levels[0].hot.hashes) > 0
    with pytest.raises(ValueError):
        lm_score.score(documents(texts), model, params)
    want = katz_of_order(train, texts, 3)
    assert all(got[i] == pytest.approx(scores, rel=1e-6) for i, scores in enumerate(want))


def test_katz_query_has_trigrams(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
    want = katz_of_order([r["text"] for r in rows if not held(r)], [r["text"] for r in rows], 3)
    got = {r["doc_id"]: r for r in QUERIES["op8_katz_lm_score"](spark, SMALL).collect()}
    assert [got[r["doc_id"]]["trigram_score"] for r in rows] == pytest.approx([w[2] for w in want], abs=1e-3)
    assert [got[r["doc_id"]]["score"] for r in rows] == pytest.approx([w[1] for w in want], abs=1e-3)


def test_katz_of_order_three_without_words(documents):
    params = lm_score.KatzParams(order=3)
    model = lm_score.train(documents([]), params)
    assert lm_score.score(documents(["a", None]), model, params).count() == 2
    rows = lm_score.train_and_score(documents([None, "", "a"]), F.col("doc_id") < 2, params)[1].collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 2] and all(math.isfinite(r["score"]) for r in rows)
    with pytest.raises(ValueError):
        lm_score.KatzParams(order=1)


def test_katz_without_training_text(documents):
    model = lm_score.train(documents([]))
    assert lm_score.score(documents(["a"]), model).first()["n_known"] == 0
    assert lm_score.score(documents([]), model).count() == 0


def test_katz_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model = lm_score.train(docs.filter(~held))
    row = lm_score.score(docs.filter(held), model).agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(docs.filter(held), langid.fit(docs.filter(~held)), "id").join(docs, "id")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count()
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark, documents):
    rows = [(0, "the house is red and the tree is tall", "en")] * 4 + [(1, "das haus ist rot und der baum ist hoch", "de")] * 4
    rows += [(2, None, "en"), (3, "the", None)]
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    got = {r["doc_id"]: r for r in langid.identify(documents([None, "", "123 !?", "the tree is", "der baum", "treehouse"]), model).collect()}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "en", "de", "en"]
    assert got[0]["score"] == 0
    assert langid.fit(spark.createDataFrame([], "id long, text string, lang string")) is None
    assert langid.identify(documents(["x"]), None).first()["lang_pred"] == "und"
    assert langid.identify(documents([]), model).count() == 0


def test_any_language_name(spark, documents):
    names = ["word", "", "a.b", "x`y", "n", "und"]
    rows = [(i, f"{chr(97 + i)}lpha {chr(97 + i)}eta {chr(97 + i)}amma", name) for i, name in enumerate(names) for _ in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(documents([r[1] for r in rows[::4]]), model).collect()}
    assert [got[i] for i in range(len(names))] == names


def test_language_scores_word_by_word(spark, documents):
    """Known words by their shares, unseen ones by the longest known n-gram from each place, without any table of codes."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der alte baum steht", "de"), ("the old tree stands", "en"), ("le vieil arbre", "fr")] * 4)]
    params = langid.LangIdParams(min_count=3, max_gram=3)
    model = langid.fit(spark.createDataFrame(rows, "id long, text string, lang string"), params)
    counts = {lang: Counter(w for _, t, at in rows if at == lang for w in t.split()) for lang in ("de", "en", "fr")}
    grams = {lang: Counter() for lang in counts}
    for lang, own in counts.items():
        for w, n in own.items():
            for size in (1, 2, 3):
                for at in range(len(w) + 3 - size):
                    grams[lang][f"^{w}$"[at : at + size]] += math.log1p(n)
    every = set().union(*counts.values())

    def word_score(lang, w):
        if w in every:
            return math.log(counts[lang][w] + 0.5) - math.log(sum(counts[lang].values()) + 1)
        padded, found = f"^{w}$", []
        for at in range(len(padded) - 1):
            for size in (3, 2, 1):
                g = padded[at : at + size]
                if len(g) == size and any(g in grams[x] for x in grams):
                    total = sum(n for k, n in grams[lang].items() if len(k) == size)
                    found.append(math.log(grams[lang][g] + 0.5) - math.log(total + 1))
                    break
        return sum(found) / len(found) if found else 0.0

    texts = ["Der neue Baum", "the newest trees", "un arbre", "xyz", "old der le", "baume!"]
    got = {r["doc_id"]: r for r in langid.identify(documents(texts), model).collect()}
    for i, text in enumerate(texts):
        w = text.lower().replace("!", "").split()
        total = {lang: sum(word_score(lang, x) for x in w) / math.sqrt(len(w)) for lang in counts}
        best = max(sorted(total), key=total.get)
        share = 1 / sum(math.exp(t - total[best]) for t in total.values())
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(share)


def test_weak_labels_find_the_good_labeller():
    patterns = {(1, 1, 2): 300, (1, 0, 2): 20, (2, 0, 2): 2000, (2, 1, 2): 15, (1, 1, 1): 40, (2, 0, 0): 300}
    post = quality.weak_labels(patterns)
    assert post[(1, 1, 2)] > 0.9 and post[(2, 0, 2)] < 0.1 and quality.weak_labels({}) == {}


def test_quality_on_held_out_labels(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    labels = spark.read.parquet(f"{at}/labels.parquet").withColumnRenamed("doc_id", "id")
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 2 == 0
    model = quality.fit(docs, labels.filter(~held))
    found = quality.classify(docs, model, id_col="id").join(labels.filter(held).withColumnRenamed("toxic", "is_toxic"), "id")
    clean, junk = found.filter("quality = 1 and is_toxic = 0"), found.filter("quality = 0")
    assert clean.filter("not kept").count() <= 0.03 * clean.count()
    assert junk.filter("kept").count() <= 0.15 * junk.count()


def test_quality_edges(documents):
    docs = documents([None, "", "   ", " ".join(f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)), "BUY!! NOW!! " * 30])
    model = quality.fit(docs.withColumnRenamed("doc_id", "id"))
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, model).collect()}
    assert got[0] and got[1] and got[2]  # five texts teach nothing of the other two
    kept = quality.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())
    empty = documents([])
    assert quality.classify(empty, quality.fit(empty.withColumnRenamed("doc_id", "id"))).count() == 0
