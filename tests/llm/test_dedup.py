import random

import pytest

from vitrine.llm.exact_dedup import exact_dedup
from vitrine.llm.line_dedup import LineDedupParams, line_dedup
from vitrine.llm.near_dedup import NearDedupParams, near_dedup

WORDS = [f"w{i}" for i in range(3000)]


def components(texts, percent, size=5):
    """By comparing all pairs."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    changed = True
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return [len(s) for s in sets], label


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_matches_all_pairs(documents, percent):
    rng = random.Random(percent)
    texts = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([3, 6, 40, 150, 500]))]
        texts += [" ".join(edited(rng, base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.1) for _ in range(3)]
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(WORDS) for _ in range(n)) for n in range(0, 120, 3)]
    texts += [None, "", " \t\n", "One two", "oNE\ttwo", "é É", "É é", "a b c d e"]
    sizes, labels = components(texts, percent)
    got = {r["doc_id"]: r for r in near_dedup(documents(texts), NearDedupParams(percent=percent)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == labels
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_dedup_edges(documents):
    assert near_dedup(documents([])).collect() == []
    rows = near_dedup(documents(["a b", "a b", "a b"], ids=[None, 4, 4])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in rows) == [("4", 4, True), ("4", 4, True), ("None", None, True)]


def test_large_group_of_alike_texts(documents):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([0.002, 0.01, 0.03, 0.06]))) for _ in range(250)]
    _, labels = components(texts, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(documents(texts), NearDedupParams(percent=85)).collect()}
    assert [got[i] for i in range(len(texts))] == labels


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(documents, keep):
    texts = ["a", "A", "a ", "a", None, "", "a", "long " * 50_000, "long " * 50_000]
    got = {r["doc_id"]: r for r in exact_dedup(documents(texts), keep=keep).collect()}
    pick = min if keep == "min" else max
    for i, t in enumerate(texts):
        group = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (pick(group), len(group), pick(group) == i)


def test_exact_dedup_edges(documents):
    assert exact_dedup(documents([])).collect() == []
    rows = exact_dedup(documents(["x", "x", "y"], ids=[None, 3, None])).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {
        (3, 3, 2, True), (None, None, 1, True), (None, 3, 2, False),
    }


def test_line_dedup(documents):
    own = [f"menu\nown {i}\n\nmenu" for i in range(10)]
    got = {r["doc_id"]: r for r in line_dedup(documents([*own, None, "", "menu"]), LineDedupParams(0.5, 3)).collect()}
    assert got[4]["text"] == "own 4\n" and (got[4]["n_lines"], got[4]["n_dropped"]) == (4, 2)
    assert (got[10]["text"], got[10]["n_lines"]) == (None, 0)
    assert (got[11]["text"], got[11]["n_lines"], got[11]["n_dropped"]) == ("", 1, 0)
    assert (got[12]["text"], got[12]["n_dropped"]) == ("", 1)
    assert line_dedup(documents([])).collect() == []


def test_copies_of_a_page_are_one_page(documents):
    texts = ["copied line\nanother"] * 40 + [f"line {i}" for i in range(10)]
    assert all(r["n_dropped"] == 0 for r in line_dedup(documents(texts), LineDedupParams(0.1, 2)).collect())


def test_line_dedup_null_host_and_carried_columns(documents):
    docs = documents([f"menu\n{i}" for i in range(4)]).selectExpr("doc_id", "text", "cast(null as string) source", "n as n_lines2")
    rows = line_dedup(docs, LineDedupParams(0.5, 2), carry=("n_lines2",)).collect()
    assert sorted((r["text"], r["n_lines2"]) for r in rows) == [(str(i), 1) for i in range(4)]


def test_texts_of_one_hash_are_no_class(spark):
    """Classes are confirmed on the words: here all shingle hashes agree."""
    from vitrine.llm.near_dedup import confirmed_classes
    from vitrine.llm.workspace import Workspace

    texts = ["one", "two", "one", "ONE", "a b c d e a b c d e", "two", "a b c d e a b c d e a b c d e"]
    digests = [" ".join(t.lower().split()).encode() for t in texts]
    found = spark.createDataFrame(
        [(i, 1, b"same" if i < 4 or i == 5 else b"other", d) for i, d in enumerate(digests)], "id long, n long, key binary, words binary"
    )
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: bytes(r["key"]) for r in confirmed_classes(found, rows, NearDedupParams(), Workspace(spark)).collect()}
    assert got[0] == got[2] == got[3] == b"same" and got[1] == got[5] != b"same" and got[4] == got[6] == b"other"


def test_set_of_words_in_another_order(documents):
    text = "a b c d e a b c d e a b c d e"
    got = {r["doc_id"]: r["component_id"] for r in near_dedup(documents([text, text + " a b c d e", "a b c d e"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_very_long_text(documents):
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(400_000))
    got = {r["doc_id"]: r for r in near_dedup(documents([long, long + " x", "x" * 2_000_000])).collect()}
    assert [got[i]["component_id"] for i in range(3)] == [0, 0, 2] and got[2]["n_shingles"] == 1


def test_filters_and_collisions(spark):
    from pyspark.sql import functions as F

    from vitrine.llm.exact_dedup import _by_text, collisions, may_hold, run_filter

    digests = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"), "id")
    held = may_hold(digests, run_filter(digests.filter("id % 3 = 0").select("digest"))).select("id").collect()
    found = {r["id"] for r in held}
    assert {i for i in range(3000) if i % 3 == 0} <= found and len(found) < 1010
    rows = spark.createDataFrame([(1, b"x", "one"), (2, b"x", "two"), (3, b"x", "one"), (4, b"y", "a"), (5, b"y", "a")], "id long, digest binary, text string")
    assert [bytes(r["digest"]) for r in collisions(rows.select("digest", "text")).collect()] == [b"x"]
    grouped = {r["id"]: (r["keep_id"], r["n"]) for r in _by_text(rows, F.min).collect()}
    assert grouped == {1: (1, 2), 3: (1, 2), 2: (2, 1), 4: (4, 2), 5: (4, 2)}


def test_only_texts_of_pairs_travel(spark):
    from vitrine.llm.near_dedup import texts_of

    texts = spark.range(5000).selectExpr("if(id = 7, null, id) id", "concat('text ', id) text")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(100, 4900, 100)] + [(100, 4999)], "a long, b long")
    for side in "ab":
        asked = {r[side] for r in pairs.collect()}
        found = {r[side]: r[f"text_{side}"] for r in texts_of(texts, pairs, side).collect()}
        assert asked <= set(found) and len(found) < len(asked) + 10
        assert all(t == f"text {i}" for i, t in found.items())
    assert texts_of(texts, pairs.limit(0), "a").count() == 0
