import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.functions.vectors import block_products, cosine_distance, softmax
from vitrine.operators import cluster, concepts, rules, search, similar
from vitrine.sources import tables
from vitrine.streaming import ingest

DAY = dt.datetime(2024, 5, 1)


def images(spark, rows):
    return spark.createDataFrame(rows, "id string, filename string, created_at timestamp_ntz")


@pytest.fixture
def small(spark):
    rows = [(f"i{k}", f"f{k}.jpg", DAY + dt.timedelta(days=k // 2)) for k in range(7)] + [("n0", "n.jpg", None)]
    ocr = spark.createDataFrame(
        [
            ("i0", "Straße 100%", 0.1), ("i1", "a_b", 0.8), ("i2", "ab", 0.9), ("i3", "back\\slash", 0.95), ("i4", None, None),
        ],
        "image_id string, text string, confidence double",
    )
    tags = spark.createDataFrame(
        [("i0", "k", "v:w", "OCR"), ("i0", "k", "v:w", "Ollama"), ("i1", "k", "x", "OCR"), ("i2", "other", "y", "OCR")],
        "image_id string, key string, value string, source string",
    )
    return images(spark, rows), ocr, tags


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.mark.parametrize(
    ("query", "found"),
    [("strasse", ["i0"]), ("%", ["i0", "i1", "i2", "i3"]), ("a_b", ["i1"]), (r"a\_b", ["i1"]), ("\\", ["i0", "i1", "i2", "i3"]), ("A%B", ["i1", "i2"]), ("zzz", [])],
)
def test_text_search(small, query, found):
    assert ids(search.text_hits(small[1], query).distinct()) == found


def test_empty_request_finds_all(small):
    assert len(ids(search.filtered_images(*small, search.SearchRequest(query="")))) == 8


def test_tags_widen_over_keys_and_count_rows(small):
    found = search.filtered_images(*small, search.SearchRequest(tags={"k": {"v:w"}, "other": {"y"}}))
    assert ids(found) == ["i0", "i2"]
    counts = {(r["key"], r["value"]): r["count"] for r in search.facet_counts(small[2], found).collect()}
    assert counts == {("k", "v:w"): 2, ("other", "y"): 1}


def test_facet_strings():
    assert search.parse_facets("k:v:w,k:x,o:y") == {"k": {"v:w", "x"}, "o": {"y"}}
    assert search.parse_facets(search.write_facets({"k": {"a", "b"}})) == {"k": {"a", "b"}}
    assert search.parse_facets("") == {}
    with pytest.raises(ValueError):
        search.parse_facets("nocolon")


def test_url_state():
    request = search.from_url("q=cat&k=1&k=2&o=x")
    assert (request.query, request.tags) == ("cat", {"k": {"1", "2"}, "o": {"x"}})
    assert search.from_url(search.to_url(request)).tags == request.tags


def test_pages_by_returned_cursor_hold_every_image_once(small):
    dated = small[0].filter("created_at is not null")
    pages = list(search.scroll(dated, small[1], small[2], search.SearchRequest(limit=2, cursor_from="returned")))
    seen = [r["id"] for p in pages for r in p.items.collect()]
    assert seen == ["i6", "i5", "i4", "i3", "i2", "i1", "i0"]
    assert not pages[-1].has_next


def test_fetched_cursor_skips_the_row_at_the_boundary(small):
    dated = small[0].filter("created_at is not null")
    pages = list(search.scroll(dated, small[1], small[2], search.SearchRequest(limit=2)))
    assert [r["id"] for p in pages for r in p.items.collect()] == ["i6", "i5", "i3", "i2", "i0"]


def test_null_times_come_first_and_end_before_a_cursor(small):
    assert search.page(small[0], 1).first()["id"] == "n0"
    rest = search.page(small[0], 50, search.Cursor(DAY, "i1"))
    assert ids(rest) == ["i0"]


def test_display_confidence_is_strict(small):
    items = {r["id"]: r["text"] for r in search.hydrate(small[0], small[1], small[2]).collect()}
    assert items["i1"] == [] and items["i2"] == ["ab (0.9)"] and items["i4"] == []


def test_unknown_item_is_empty(small):
    row = search.item_detail(*small, "zz").first()
    assert (row["originalFileName"], row["text"], row["tags"]) == (None, [], [])


def test_cosine_distance_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.0, 2.0, 1.0] and math.isnan(got[3]) and got[4] is None


def test_nearest_orders_nan_and_null_last(spark):
    pics = images(spark, [(k, k, DAY) for k in "abcd"])
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [0.5, 0.5]), ("d", [0.0, 1.0]), ("gone", [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "image_id string, embedding array<float>")
    got = [r["image_id"] for r in similar.nearest_images(pics, vectors, [1.0, 0.0]).collect()]
    assert got == ["a", "d", "d", "b", "c"]


def test_threshold_is_strict(spark):
    pics = images(spark, [("a", "a", DAY)])
    vectors = spark.createDataFrame([("a", [0.0, 1.0])], "image_id string, embedding array<float>")
    refs = spark.createDataFrame([(1, 1, [1.0, 0.0])], "id int, concept_image_set_id int, embedding array<float>")
    sets = spark.createDataFrame([(1, 9, "s")], "id int, concept_id int, name string")
    top = lambda t, c=9: similar.concept_top_images(pics, vectors, refs, sets, c, t).count()
    assert (top(1.0), top(1.1), top(1.1, 8)) == (0, 1, 0)


def test_softmax(spark):
    got = spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0]
    assert got == [0.5, 0.5]


def test_centroid_of_one_and_of_opposites(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [1.0, 0.0]), ("b", [-1.0, 0.0])], "k string, embedding array<float>")
    got = {r["k"]: r["centroid"] for r in concepts.centroids(df, ["k"]).collect()}
    assert got["a"] == [0.6, 0.8] and got["b"] == [None, None]


def test_rules():
    flat = rules.flatten({"a": {"k": ["1", "2"]}, "b": "c", "c": "a"})
    assert flat == [("a", "k", "1"), ("a", "k", "2"), ("b", "k", "1"), ("b", "k", "2"), ("c", "k", "1"), ("c", "k", "2")]
    with pytest.raises(ValueError):
        rules.flatten({"a": "b", "b": "a"})


def test_tagging_edges(spark):
    rows = [("i", "Heavy/Metal", 0.4), ("i", "heavy/metal again", 0.9), ("j", "heavy/metal", 0.39), ("k", "heavy/metal", None)]
    ocr = spark.createDataFrame(rows, "image_id string, text string, confidence double")
    flat = rules.flatten({"heavy/metal": {"g": "metal"}, "again": {"g": "metal"}})
    assert [tuple(r) for r in rules.tags_from_ocr(ocr, flat).collect()] == [("i", "g", "metal", "OCR")]
    words = spark.createDataFrame([("a", "un écat"), ("b", "a CAT!"), ("c", None)], "image_id string, text string")
    assert [r["image_id"] for r in rules.tags_from_descriptions(words, rules.flatten({"cat": {"k": "v"}})).collect()] == ["b"]
    assert rules.tags_from_ocr(ocr, []).count() == 0


def test_sizes_and_names(spark):
    rows = [(1600, 1200), (1601, 1000), (10, 3200)]
    df = spark.createDataFrame(rows, "w int, h int")
    got = [tuple(r) for r in df.select(text.bounded_side(F.col("w"), F.col("h")), text.bounded_side(F.col("h"), F.col("w"))).collect()]
    assert got == [(1600, 1200), (1600, 999), (5, 1600)]
    df = spark.createDataFrame([("a.MP4",), ("b.jpg",)], "n string")
    assert [r[0] for r in df.select(text.is_video(F.col("n"))).collect()] == [True, False]
    assert spark.range(1).select(text.polygon(F.lit("[[1, 2], [3.5, 4]]"))).first()[0] == [[1.0, 2.0], [3.5, 4.0]]


def test_one_and_one_or_none(spark):
    assert tables.one_or_none(spark.range(0)) is None
    for n in (0, 2):
        with pytest.raises(LookupError):
            tables.one(spark.range(n))


def test_sinks_and_listing(spark, tmp_path):
    tags = lambda source, v: spark.createDataFrame([("i", "k", v, source)], "image_id string, key string, value string, source string")
    at = str(tmp_path / "tags")
    tables.replace_sources(tags("OCR", "1").unionByName(tags("Ollama", "1")), at, ["OCR", "Ollama"])
    tables.replace_sources(tags("OCR", "2"), at, ["OCR"])
    assert sorted((r["source"], r["value"]) for r in spark.read.parquet(at).collect()) == [("OCR", "2"), ("Ollama", "1")]
    tables.report(spark.range(3), str(tmp_path / "report"), F.desc("id"))
    assert [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()] == ["2", "1", "0"]
    folder = tmp_path / "pics"
    folder.mkdir()
    for name in ("a.jpg", "b.MP4"):
        (folder / name).write_bytes(b"x")
    names = tables.listing(spark, str(folder), text.is_video(F.col("filename")))
    assert [r[0] for r in names.collect()] == ["a.jpg"]


def test_unregister_takes_children(spark):
    pics, gone = images(spark, [("a", "a", DAY), ("b", "b", DAY)]), spark.createDataFrame([("a",)], "id string")
    children = {"tags": spark.createDataFrame([("a", 1), ("b", 2)], "image_id string, x int"), "concepts": spark.range(2)}
    out = tables.unregistered(pics, children, gone)
    assert ids(out["images"]) == ["b"] and out["tags"].count() == 1 and "concepts" not in out


def test_ingestion(spark):
    pics = spark.createDataFrame([("a", b"ok"), ("b", b""), ("c", b"ok"), ("d", b"ok")], "id string, content binary")
    events = spark.createDataFrame(
        [("c", "p", "processing", DAY), ("c", "p", "done", DAY + dt.timedelta(1)), ("d", "p", "failed", DAY)],
        "image_id string, pipeline string, status string, started_at timestamp_ntz",
    )

    def model(content: bytes) -> str:
        if not content:
            raise ValueError("empty")
        return content.decode()

    todo = ingest.claimable(pics, ingest.latest_status(events), "p")
    assert ids(todo) == ["a", "b", "d"]
    out = ingest.apply_model(todo, model, "string", "p")
    assert {r["image_id"]: r["status"] for r in out.collect()} == {"a": "done", "b": "failed", "d": "done"}
    assert [r["message"] for r in ingest.errors_of(out, "ocr").collect()] == ["ValueError: empty"]


def test_hdbscan_finds_two_groups(spark):
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(0, 0.05, (12, 2)), rng.normal(5, 0.05, (12, 2)), [[20.0, -20.0], [-30.0, 9.0]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    label = {r["id"]: r["label"] for r in cluster.hdbscan(df).collect()}
    assert len({label[i] for i in range(12)}) == 1 and len({label[i] for i in range(12, 24)}) == 1
    assert label[0] != label[12] and label[24] == label[25] == -1


def _cloud(spark, n=60):
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(c, 0.3, (n // 3, 3)) for c in (0, 3, 6)])
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>")


def test_chunks_give_the_tree_of_the_whole(spark):
    points, df = _cloud(spark)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 4]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    joined, weights = {0}, []
    while len(joined) < len(points):
        weight, new = min((reach[i, j], j) for i in joined for j in range(len(points)) if j not in joined)
        joined.add(new)
        weights.append(weight)
    for most, chunk in ((1000, 1000), (5, 7)):
        found = cluster.core_distances(df, 5, most, chunk)
        assert np.allclose([r["core"] for r in found.orderBy("id").collect()], core)
        edges = cluster.spanning_tree(df.join(found, "id"), chunk).collect()
        assert np.allclose(sorted(r["weight"] for r in edges), sorted(weights))
        labels = cluster.hdbscan(df, vector_col="vector", most=most, chunk=chunk).orderBy("id").collect()
        assert [len({r["label"] for r in labels[k : k + 20]} - {-1}) for k in (0, 20, 40)] == [1, 1, 1]


def test_clusters_of_few_or_null_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, None)], "id long, embedding array<double>")
    assert sorted(tuple(r) for r in cluster.hdbscan(df).collect()) == [(1, -1), (2, -1)]
    assert cluster.hdbscan(df.limit(0)).collect() == []


def test_block_products_dealt_over_chunks(spark):
    def keep(a, b):
        i, j = np.nonzero(a.rows @ b.rows.T > 10)
        return pd.DataFrame({"a": a.ids[i], "b": b.ids[j]})

    points, df = _cloud(spark)
    odd = df.unionByName(spark.createDataFrame([(100, None), (101, [1.0]), (102, [None, 1.0, 1.0])], df.schema))
    want = sorted(zip(*map(list, np.nonzero(points @ points.T > 10)), strict=True))
    for most in (1000, 10):
        found = block_products(odd, odd, keep, "a long, b long", most, 9)
        assert sorted(tuple(r) for r in found.collect()) == want


def test_folder_ingestion(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.jpg", b"ok"), ("b.jpg", b"x"), ("c.mp4", b"x")):
        (folder / name).write_bytes(data)

    def model(content: bytes) -> int:
        return 10 // (len(content) - 1)

    pics = spark.createDataFrame([(1, "a.jpg"), (2, "b.jpg"), (3, "gone.jpg")], "id long, filename string")
    contents = spark.read.format("binaryFile").load(str(folder)).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    none = tables.empty(spark, "image_processing_status")
    out = ingest.ingest_folder(pics, contents, none, model, "long", "len")
    assert {r["image_id"]: r["status"] for r in out.collect()} == {"1": "done", "2": "failed", "3": "failed"}
    assert ingest.outcome_tables(out, "read")["processing_errors"].count() == 2
    for _ in range(2):
        query = ingest.stream_folder(spark, str(folder), model, "long", "len", str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["image_id"]: r["result"] for r in got.collect()} == {"a.jpg": 10, "b.jpg": None}


def test_folder_recognition_takes_failed_images_again(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "tables")
    folder.mkdir()
    for name, data in (("a.jpg", b"ok"), ("b.jpg", b"x"), ("c.MP4", b"x")):
        (folder / name).write_bytes(data)

    def decode(content: bytes):
        if content == b"x":
            raise ValueError("no picture")
        return content, 4, 2

    readers = {"en": lambda p: [([(0, 0), (1, 2)], p.decode(), 0.9)], "de": lambda p: []}
    states = []
    for _ in range(2):
        out = ingest.recognise_folder(spark, str(folder), root, decode, readers)
        states.append(sorted(r["status"] for r in out.collect()))
    assert states == [["done", "failed"], ["failed"]]
    rows = {name: tables.stored(spark, root, name) for name in ("images", "ocr_texts", "image_metrics", "processing_errors", "image_processing_status")}
    assert {n: df.count() for n, df in rows.items()} == {
        "images": 2, "ocr_texts": 1, "image_metrics": 1, "processing_errors": 2, "image_processing_status": 6
    }
    told = rows["ocr_texts"].first()
    assert (told["text"], told["language"], told["bbox"]) == ("ok", "en", [[0.0, 0.0], [1.0, 2.0]])


def test_embedding_of_no_file_and_no_length(spark):
    df = spark.createDataFrame([(1, b"ab"), (2, None), (3, b"")], "id long, content binary")
    got = {r["image_id"]: r for r in ingest.embed(df, lambda batch: [[3.0 * len(x), 4.0 * len(x)] for x in batch]).collect()}
    assert np.allclose(got["1"]["embedding"], [0.6, 0.8])
    assert got["2"]["error_message"] == "no file" and got["3"]["error_message"] == "vector of length 0"


def test_structured_description(spark):
    got = spark.range(1).select(text.structured_description(F.lit('Sure: {"description": "d", "tags": ["x"]} ok')).alias("d")).first()["d"]
    assert (got["description"], got["tags"], got["template"]) == ("d", ["x"], None)


def test_sources_without_new_rows_and_small_faults(spark, tmp_path):
    at = str(tmp_path / "by source")
    rows = [("i1", "a/b"), ("i2", "OCR"), ("i3", "OCR")]
    tables.replace_sources(spark.createDataFrame(rows, "image_id string, source string"), at, ["a/b", "OCR"])
    assert spark.read.parquet(at).count() == 3
    none = spark.createDataFrame([], "image_id string, source string")
    tables.replace_sources(none, at, ["a/b", "never there"])
    assert [r["source"] for r in spark.read.parquet(at).collect()] == ["OCR", "OCR"]
    with pytest.raises(ValueError):
        tables.replace_sources(spark.createDataFrame(rows, "image_id string, source string"), at, ["OCR"])
    tables.replace_all(spark.range(3), str(tmp_path / "x"))
    tables.append(spark.range(2), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 5
    folder = tmp_path / "pics"
    folder.mkdir()
    (folder / "one.jpg").write_bytes(b"abc")
    assert tables.file_exists(spark, str(folder / "one.jpg")) and not tables.file_exists(spark, str(folder / "two.jpg"))
    assert not tables.file_exists(spark, str(folder))
    named = spark.createDataFrame([("i1", "one.jpg"), ("i2", "two.jpg")], "id string, filename string")
    assert [(r["id"], bytes(r["content"])) for r in tables.file_bytes(spark, str(folder), named).collect()] == [("i1", b"abc")]
    kinds = spark.createDataFrame([(" IMAGE/JPEG ; q=1",), ("image/PNG",), (None,), ("text/html",)], "k string")
    assert [r[0] for r in kinds.select(text.extension(F.col("k"))).collect()] == [".jpg", ".png", ".bin", ".bin"]


def test_pages_go_on_after_a_null_time(spark):
    rows = [("a", "a.jpg", None), ("b", "b.jpg", None), ("c", "c.jpg", DAY), ("d", "d.jpg", DAY)]
    cursor = search.decode_cursor(search.encode_cursor(search.Cursor(None, "b")))
    assert cursor == search.Cursor(None, "b")
    assert [r["id"] for r in search.page(images(spark, rows), 5, cursor).collect()] == ["a", "d", "c"]
    assert [r["id"] for r in search.page(images(spark, rows), 5, search.Cursor(DAY, "d")).collect()] == ["c"]
