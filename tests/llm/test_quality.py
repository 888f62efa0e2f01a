import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vitrine.llm import quality
from vitrine.llm.word_kernels import buffers, words


def slow_em(votes, human, rounds):
    """Document by document: each labeller's rates from the posteriors, the posteriors from the rates."""
    post = [(human if v[-1] == 1 else 1 - human) if v[-1] != 2 else None for v in votes]
    rest = [(v.count(1) + 0.1) / (v.count(1) + v.count(0) + 0.2) * 0.9 + 0.05 * (1 in v) for v in votes]
    first = True
    post = [r if p is None else p for p, r in zip(post, rest, strict=True)]
    for _ in range(rounds):
        use = [v[-1] != 2 for v in votes] if first else [True] * len(votes)
        first = False
        weight = [sum(1 - p for p, u in zip(post, use, strict=True) if u), sum(p for p, u in zip(post, use, strict=True) if u)]
        rates = {}
        for c in (0, 1):
            for k in range(len(votes[0])):
                got = [0.5, 0.5, 0.5]
                for v, p, u in zip(votes, post, use, strict=True):
                    got[v[k]] += u * (p if c else 1 - p)
                if k == len(votes[0]) - 1:
                    right = 1 if c else 0
                    got = [got[x] + 100 * (human if x == right else 1 - human) for x in (0, 1)]
                    rates[c, k] = [g / sum(got) for g in got] + [1]
                else:
                    rates[c, k] = [g / sum(got) for g in got]
        prior = [(w + 1) / (sum(weight) + 2) for w in weight]
        like = [[math.log(prior[c]) + sum(math.log(rates[c, k][x]) for k, x in enumerate(v)) for c in (0, 1)] for v in votes]
        post = [1 / (1 + math.exp(a - b)) for a, b in like]
    return post


def test_weak_labels_equal_em_document_by_document():
    rng = random.Random(3)
    votes = []
    for _ in range(300):
        bad = rng.random() < 0.3
        say = lambda right: (bad if rng.random() < right else not bad) * 1  # noqa: E731, B023
        votes.append((say(0.9), say(0.7) if rng.random() < 0.6 else 2, say(0.8), say(0.97) if rng.random() < 0.4 else 2))
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    got = quality.weak_labels(counts, 0.98, rounds=30)
    assert np.allclose([got[v] for v in votes], slow_em(votes, 0.98, 30), atol=1e-9)


def corpus(rng, stems, n=1500):
    """Documents of a made-up language; bad ones hold one to three words of a few stems; some stand in groups of copies."""
    syllables = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiouäø") for _ in range(k)) for k in (1, 1, 2, 2) for _ in range(12)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows = []
    while len(rows) < n:
        bad = rng.random() < 0.12
        text = [word() for _ in range(rng.choice([15, 60, 300, 1500]))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(stems) + word())
        for _ in range(rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 25])):
            copy = list(text)
            copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), 1, int(bad)))
    return rows


def test_other_words_and_copies(spark):
    """A vocabulary that no list knows: clean documents of any length stay, rare words of copied bad documents teach nothing."""
    rows = corpus(random.Random(11), ["xqor", "wyzzan"], 6000)
    frame = spark.createDataFrame(rows, "id long, text string, quality int, toxic int")
    held = F.col("id") % 3 == 0
    model = quality.fit(frame.select("id", "text"), frame.filter(~held).select("id", "quality", "toxic"))
    found = quality.classify(frame.filter(held), model, id_col="id").withColumnRenamed("toxic", "score").join(frame, "id")
    size = F.size(F.split("text", " "))
    told = found.groupBy("toxic", (size > 200).alias("long")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {(r["toxic"], r["long"]): r["kept"] for r in told}
    assert kept[0, False] >= 0.97 and kept[0, True] >= 0.97
    assert kept[1, False] <= 0.1 and kept[1, True] <= 0.1


def test_forms_are_words_and_their_beginnings():
    texts = pa.array(["Éclair, «don't» x", None, "", "ab12cd élanvital"])
    forms, rows = quality.word_forms(pa.compute.utf8_lower(texts.fill_null("")))
    by_row = [len(set(forms[rows == k].tolist())) for k in range(4)]
    assert by_row == [4 + 2, 0, 0, 3 + 2]  # éclair don t x + écla, éclai; ab cd élanvital + two
    data, offsets = buffers(pa.array(["éclair"]))
    assert words(data, offsets)[0][0] in forms[rows == 0]


def test_shares():
    look = quality.Look(*(lambda t: (t, *buffers(t)))(pa.array(["AB | ab ab!! c,", ""])))
    caps, pipes, doubled, plain, distinct, echo = look.shares[0]
    assert (caps, pipes, doubled, echo) == (2 / 7, 0.2, 0.2, 0.0)
    assert plain == 3 / 5 and distinct == 4 / 5 and not look.shares[1].any()


def test_words_of_one_pattern_have_their_own_hashes():
    """Polynomials modulo a power of two give Thue-Morse words one hash."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [w for n in (16, 64, 65, 128, 1024, 4096) for w in (word[:n], word[:n].translate(str.maketrans("ab", "ba")))]
    data, offsets = buffers(pa.array(texts))
    assert len(set(words(data, offsets)[0].tolist())) == len(texts)


def test_word_hashes_follow_the_words():
    texts = ["One two  three", None, "one\tTWO three x" + "y" * 100, "é É ÿ", "x" * 64 + " " + "x" * 65]
    data, offsets = buffers(pa.array(texts))
    got, at = words(data, offsets)
    plain = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())]
    assert len(plain) == len(got) == at[-1]
    assert len({*zip(plain, got.tolist(), strict=True)}) == len(set(plain)) == len(set(got.tolist()))


def test_every_document_and_label_teaches(spark, monkeypatch):
    """No document is left out, however many there are: the weights that the scorers are fitted on sum to all of them."""
    n, seen = 30_000, []
    rows = spark.range(n).selectExpr("id", "concat_ws(' ', transform(sequence(1, 8), k -> concat('w', translate(cast(id * 8 + k as string), '0123456789', 'abcdefghij')))) text")
    slow, linear = quality.telling_forms, quality.fit_linear
    monkeypatch.setattr(quality, "fit_linear", lambda row, col, m, y, w, steps: seen.append(w.sum()) or linear(row, col, m, y, w, 2))
    monkeypatch.setattr(quality, "telling_forms", lambda blocks, *rest: seen.append(blocks.agg(F.sum("n")).first()[0]) or slow(blocks, *rest))
    labels = rows.selectExpr("id", "1 quality", "if(id % 10 = 0, 1, 0) toxic")
    quality.fit(rows, labels)
    taught = rows.filter(quality._dice("held") >= 0.1).count()
    assert seen == [n] * 4 + [taught] * 2


def test_copies_are_one_witness(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, passage = [word() for _ in range(200)], [word() for _ in range(12)]
    texts = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 200, 4)]  # 50 near copies
    texts += [" ".join([word() for _ in range(150)] + passage) for _ in range(300)]  # one passage in 300 texts
    frame = spark.createDataFrame([(t, -1, -1, -1, 0) for t in texts], "text string, quality int, toxic int, fold int, held int").coalesce(1)
    blocks = quality.seen_blocks(frame)
    weights = np.concatenate([b.weight for b in quality._blocks(iter(blocks.join(quality.near_copies(blocks), "block", "left").toArrow().to_batches()))])
    assert weights[:50].sum() <= 3 * quality.WHOLE and weights[50:].sum() >= 295 * quality.WHOLE


def test_ordinary_words_of_bad_documents_are_not_counted_everywhere(spark):
    """Candidates are few, though every word stands in many bad documents, and no form is lost that counting finds."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(300)]
    rows = []
    for i in range(3000):
        toxic = int(rng.random() < 0.2)
        text = [rng.choice(vocabulary) for _ in range(40)] + ["xyz"] * toxic * (rng.random() < 0.5) + ["yzx"] * (rng.random() < (0.3 if toxic else 0.02))
        rows.append((" ".join(text), 1, toxic, i % 2, 0))
    alone = ["".join(rng.choice("klmnop") for _ in range(3)) for _ in range(100)]
    rows += [(" ".join([*alone[:k], "kk" + alone[k], *alone[k + 1 :]]), 1, 1, 0, 0) for k in range(40)]  # near copies, one witness
    frame = spark.createDataFrame(rows, "text string, quality int, toxic int, fold int, held int").repartition(4)
    blocks = quality.seen_blocks(frame)
    blocks = blocks.join(quality.near_copies(blocks), "block", "left").persist()
    believed, params = lambda seen: np.where(seen.fold == 0, seen.toxic, np.nan), quality.QualityParams()
    for purity in (0.5, 0.95):
        n, bad = {}, {}
        for seen in quality._blocks(iter(blocks.toArrow().to_batches())):
            y = believed(seen)
            for row, form in zip(seen.row.tolist(), seen.form.tolist(), strict=True):
                if not math.isnan(y[row]):
                    key = int(seen.forms[form])
                    n[key] = n.get(key, 0) + seen.weight[row] / quality.WHOLE
                    bad[key] = bad.get(key, 0) + seen.weight[row] / quality.WHOLE * y[row]
        candidates, base = quality.candidate_forms(blocks, believed, params, purity)
        keys = np.array(sorted(n), np.uint64)
        of = lambda d: np.array([d[k] for k in sorted(n)])  # noqa: E731, B023
        want = keys[quality.surprising(of(n), of(bad), base, params.chance) & (of(bad) >= purity * of(n))]
        assert len(want) == (2 if purity == 0.5 else 1) and set(want) <= set(candidates) and len(candidates) <= 10 < len(keys)
        assert quality.telling_forms(blocks, believed, params, purity).tolist() == want.tolist()
    blocks.unpersist()
