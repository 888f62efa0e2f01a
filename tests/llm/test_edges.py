"""All queries and the pipeline on odd and on empty tables."""

import hashlib

import pytest

import corpus_pipeline
from vitrine.llm.queries import QUERIES

DOCUMENTS = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, words int, digest string, kept boolean, "
    "value int, term string, n int, block int, kind int, label int, junk double, keep_id string, component_id long, near int"
)
TABLES = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int, id long, text string",
    "benchmark": "item_id string, text string, id long, pos int",
    "conversations": "conv_id long, turn long, role string, text string, id long, payload string",
}
LONG = " ".join(f"w{i % 5000}x" for i in range(120_000))
SAME = "the same text on two rows and once more, long enough to have shingles of words"
TEXTS = {1: None, 2: "", 3: LONG, 4: SAME, 5: SAME, 6: "\n\n \n", 7: "x" * 200_000, 8: "a tie\na tie\na tie", 9: "Ünïcode \U0001f600 ẞ İ Σ", 10: "\x00\x01"}


def _folder(spark, at, rows):
    for name, schema in TABLES.items():
        width = schema.count(",") + 1
        full = [(*r, *[None] * (width - len(r))) for r in rows.get(name, [])]
        spark.createDataFrame(full, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    docs = [(i, t, "en" if i % 2 else None, "src0" if i % 3 else None, 1) for i, t in TEXTS.items()]
    docs += [docs[4], (None, SAME, None, None, None)]
    rows = {
        "documents": docs,
        "labels": [(4, 1, 0), (4, 0, None), (9, None, 1), (None, 0, 0), (77, 0, 1)],
        "benchmark": [("b0", None), ("b1", ""), ("b2", SAME), ("b2", SAME), (None, "no item"), ("b3", " ".join(LONG.split()[100:130]))],
        "conversations": [(1, 0, "user", None), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (2, None, None, ""), (None, 0, "user", "x")],
    }
    return _folder(spark, tmp_path_factory.mktemp("odd"), rows)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _folder(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    # the one conversation that the query adds
    assert QUERIES[name](spark, empty).count() == int("chat" in name)


def test_pipeline_on_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


OF_DOCUMENTS = sorted(n for n in QUERIES if n.startswith("op") and not n.startswith(("op7", "op10")))


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_odd_documents_have_a_row_each(spark, odd, name):
    ids = sorted(r["doc_id"] or 0 for r in QUERIES[name](spark, odd).select("doc_id").collect())
    assert ids == sorted([*TEXTS, 5, 0])


def test_odd_documents_in_groups(spark, odd):
    exact = {r["doc_id"]: r for r in QUERIES["op5_exact_dedup"](spark, odd).collect()}
    assert (exact[4]["keep_id"], exact[4]["group_size"], exact[5]["kept"], exact[4]["kept"]) == (5, 4, True, False)
    assert exact[1]["keep_id"] == 2 and exact[1]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    near = {r["doc_id"]: r for r in QUERIES["op1_minhash_near_dedup"](spark, odd).collect()}
    assert (near[5]["component_id"], near[5]["kept"], near[4]["kept"], near[1]["n_shingles"]) == (4, False, True, 0)
    hits = {r["doc_id"]: r for r in QUERIES["op9_benchmark_decontamination"](spark, odd).collect()}
    assert hits[4]["n_hit"] == hits[4]["n_words"] and hits[4]["n_items"] == 1 and hits[3]["n_hit"] >= 30 and hits[1]["n_words"] == 0
    counts = {r["doc_id"]: r for r in QUERIES["op8_katz_lm_score"](spark, odd).collect()}
    assert counts[3]["n_tokens"] == 120_001 and counts[1]["n_tokens"] == 1
    languages = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op3_language_id"](spark, odd).collect()}
    assert languages[1] == languages[6] == "und"


def test_pieces_of_odd_documents(spark, odd):
    rows = QUERIES["op10_best_fit_packing"](spark, odd).collect()
    ends = {}
    for r in rows:
        ends.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    assert set(ends) == {*TEXTS, None} and ends[1] == [(0, 0, 1)] and len(ends[5]) == 2
    pieces = sorted(ends[3])
    assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False)) and all(p[2] == 1024 for p in pieces[1:])


def test_conversations_without_turn_or_role(spark, odd):
    rows = {r["conv_id"]: r for r in QUERIES["op7_chat_format"](spark, odd).collect()}
    assert set(rows) == {-1, 1, 2, None} and rows[1]["n_turns"] == 3 and rows[1]["loss_chars"] == 4 and rows[2]["n_turns"] == 1


def test_pipeline_on_odd_documents(spark, odd):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, odd).collect()}
    assert not ids & {4, 5, 3} and 9 in ids
