import random
import re

from vitrine.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, width=10):
    out = []
    for t in texts:
        w = words(t)
        hits, found = set(), set()
        for name, item in items:
            i = words(item)
            k = min(width, len(i))
            for s in range(len(i) - k + 1 if i else 0):
                for at in range(len(w) - k + 1):
                    if w[at : at + k] == i[s : s + k]:
                        hits |= set(range(at, at + k))
                        found.add(name)
        out.append((len(w), sorted(hits), sorted(found)))
    return out


def test_matches_brute_force(spark, documents):
    rng = random.Random(2)
    common = ["the", "of", "and", "Éa", "éa", "x1"]
    draw = lambda n: [rng.choice(common) if rng.random() < 0.6 else f"t{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(draw(rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(14)]
    items += [(20, None), (21, ""), (22, "the the the the the the the the the the the"), (23, items[0][1])]
    texts = [" ".join(draw(200)) for _ in range(6)]
    for _, item in items:
        w = (item or "").split()
        texts.append(" ".join([*draw(30), *w, *draw(10), *w[:9], *draw(4), *[x.upper() for x in w], *draw(5)]))
        texts.append("--" + "..".join(w) + "!!\n" + "the " * 25)
    texts += [None, "", "...", "the " * 5000]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(documents(texts), table).collect()}
    for i, (n, hits, found) in enumerate(brute(texts, items)):
        assert (got[i]["n_words"], got[i]["hits"], sorted(got[i]["items"])) == (n, hits, found), texts[i]


def test_nothing_to_look_for(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["hits"] for r in decontaminate(documents(["a b"]), none).collect()] == [[]]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(documents([]), some).count() == 0


def brute_near(texts, items, width=10, slack=1, misses=1):
    out = []
    for t in texts:
        w, found = words(t), set()
        for name, item in items:
            i = words(item)
            k = min(width, len(i))
            for shift in range(-len(i) - slack, len(w) + slack + 1):
                there = [any(0 <= q < len(w) and w[q] == x for q in range(p + shift - slack, p + shift + slack + 1)) for p, x in enumerate(i)]
                if i and any(sum(there[s : s + k]) >= k - (misses if k == width else 0) for s in range(len(i) - k + 1)):
                    found.add(name)
        out.append(sorted(found))
    return out


def test_proximity_matches_brute_force(spark, documents):
    rng = random.Random(7)
    common = ["the", "of", "and", "a"]
    draw = lambda n: [rng.choice(common) if rng.random() < 0.5 else f"t{rng.randrange(80)}" for _ in range(n)]
    items = [(i, " ".join(draw(n))) for i, n in enumerate([1, 3, 9, 10, 10, 11, 15, 25, 40])] + [(20, ""), (21, "the the the of the")]
    texts = [None, "", *(" ".join(draw(150)) for _ in range(4))]
    for _, item in items:
        for every in (6, 10):
            for edit in (lambda x: ["new"], lambda x: [x, "new"], lambda x: []):
                w = [y for at, x in enumerate(words(item)) for y in (edit(x) if at % every == every // 2 else [x])]
                texts.append(" ".join([*draw(20), *w, *draw(20)]))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate(documents(texts), table).collect()}
    want = brute_near(texts, items)
    assert [sorted(got[i]["near"]) for i in range(len(texts))] == want
    assert all(set(r["items"]) <= set(r["near"]) for r in got.values())
    assert any(set(r["near"]) - set(r["items"]) for r in got.values())


def test_repeated_word_against_a_long_item(spark, documents):
    """Every place of the text is a shift of the item: work by length times length, hits listed once."""
    table = spark.createDataFrame([(1, "ho " * 300), (2, "ho " * 40 + "hum"), (3, "Σίσυφος' ΟΔΟΣ. rare")], "item_id long, text string")
    texts = ["ho " * 6000, "ho " * 9, "x " + "ho " * 50 + "hum ho", "a Σίσυφος ΟΔΟΣ rare b", "ΟΔΟΣ' rare"]
    got = {r["doc_id"]: r for r in decontaminate(documents(texts), table).collect()}
    assert got[0]["hits"] == list(range(6000)) and sorted(got[0]["items"]) == [1, 2]
    assert got[1]["hits"] == [] and got[2]["hits"] == list(range(1, 52)) and got[3]["hits"] == [1, 2, 3] and got[4]["hits"] == []
