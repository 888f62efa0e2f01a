"""Registered catalogue queries and their DuckDB equivalents.

Thresholds are wider than the operators' defaults because the test vectors are nearly orthogonal.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import text, vectors
from vitrine.operators import cluster, concepts, rules, search, similar
from vitrine.plans.fixtures import Catalogue, over, scratch
from vitrine.sources import tables
from vitrine.streaming import ingest

THRESHOLD, IMAGE, CONCEPT = 0.75, 0, 3
WORDS = {
    "that": {"common": "that", "kind": ["pronoun", "conjunction"]},
    "with": {"kind": "preposition"},
    "from": "with",
    "license": {"topic": "licence"},
}
WORD_RULES = {"que": {"lang_hint": ["fr", "es"]}, "with": {"lang_hint": "en"}, "und": {"lang_hint": "de"}}
NAMES = {"english": ["that", "with"], "french": ["que"], "legal": ["license", "copyright"]}
AT = datetime(2024, 1, 3)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Registers a query over a catalogue and its DuckDB form."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = over(views, sql) if views else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


NEAR = "list_cosine_distance(embedding, (select embedding from vectors where image_id = 0))"


@query(f"""select image_id, filename, round({NEAR}, 6) as distance from vectors v join images i on i.id = v.image_id
where image_id <> 0 order by {NEAR}, image_id limit 10""", "images vectors")
def similar_images(c: Catalogue) -> DataFrame:
    return rounded(similar.nearest_images(c.images, c.vectors, c.vector_of(IMAGE), 10, IMAGE), "distance")


@query("""select image_id, filename, count(*) as match_count, round(avg(d), 6) as avg_distance, round(sum(exp(-d)), 6) as score
from (select image_id, i.filename, list_cosine_distance(v.embedding, r.embedding) as d
      from vectors v join images i on i.id = v.image_id, refs r join sets s on r.concept_image_set_id = s.id where s.concept_id = 3)
where d < 0.75 group by image_id, i.filename order by sum(exp(-d)) desc, image_id limit 50""".replace("group by image_id, i.filename", "group by image_id, filename"), "images vectors sets refs")
def concept_top_images(c: Catalogue) -> DataFrame:
    found = similar.concept_top_images(c.images, c.vectors, c.concept_images, c.concept_image_sets, CONCEPT, THRESHOLD)
    return rounded(found, "avg_distance", "score")


@query(f"""select name, id, round(avg(d), 6) as avg_distance
from (select c.name, c.id, {NEAR.replace('(embedding,', '(r.embedding,')} as d
      from refs r join sets s on r.concept_image_set_id = s.id join concepts c on c.id = s.concept_id)
where d < 0.75 group by name, id""", "vectors concepts sets refs")
def image_top_concepts(c: Catalogue) -> DataFrame:
    found = similar.image_top_concepts(c.concept_images, c.concept_image_sets, c.concepts, c.vector_of(IMAGE), THRESHOLD)
    return rounded(found, "avg_distance")


@query(f"""select r.id as concept_image_id, c.id, c.name, s.id as set_id, s.name as set_name, round(d, 6) as distance
from (select *, {NEAR} as d from refs) r join sets s on r.concept_image_set_id = s.id join concepts c on c.id = s.concept_id
order by d, r.id limit 10""", "vectors concepts sets refs")
def concept_images_nearest(c: Catalogue) -> DataFrame:
    return rounded(similar.nearest_references(c.concept_images, c.concept_image_sets, c.concepts, c.vector_of(IMAGE)), "distance")


@query(f"""select image_id, filename, round({NEAR}, 6) as distance from vectors v join images i on i.id = v.image_id
order by {NEAR}, image_id limit 10""", "images vectors")
def concept_vector_top_images(c: Catalogue) -> DataFrame:
    return rounded(similar.nearest_images(c.images, c.vectors, c.vector_of(IMAGE), 10), "distance")


@query("""select image_id, concept_id, count(*) as matches, round(min(d), 6) as least_distance
from (select image_id, s.concept_id, list_cosine_distance(v.embedding, r.embedding) as d
      from vectors v join images i on i.id = v.image_id, refs r join sets s on r.concept_image_set_id = s.id)
where d < 0.75 group by image_id, concept_id""", "images vectors sets refs")
def match_counts(c: Catalogue) -> DataFrame:
    found = similar.match_counts(c.images, c.vectors, c.concept_images, c.concept_image_sets, THRESHOLD)
    return rounded(found, "least_distance")


UPPER = "replace(upper(text), 'ẞ', 'SS')"


@query(f"select id, filename from images where id in (select image_id from ocr_texts where {UPPER} like '%TH_T%ING%' escape '\\')", "images ocr_texts")
def search_text(c: Catalogue) -> DataFrame:
    request = search.SearchRequest(query="th_t%ing")
    return search.filtered_images(c.images, c.ocr_texts, c.tags, request).select("id", "filename")


WANTED = {"lang": {"fr", "de"}, "quality": {"0"}}
TAGGED = "(select image_id from tags where key = 'lang' and value in ('fr', 'de') or key = 'quality' and value = '0')"


@query(f"select id, filename from images where id in {TAGGED}", "images tags")
def search_tags_or(c: Catalogue) -> DataFrame:
    return search.filtered_images(c.images, c.ocr_texts, c.tags, search.SearchRequest(tags=WANTED)).select("id", "filename")


@query(f"""select id, filename from images where id in {TAGGED}
and id in (select image_id from ocr_texts where {UPPER} like '%ENT%' escape '\\')""", "images tags ocr_texts")
def search_text_and_tags(c: Catalogue) -> DataFrame:
    request = search.SearchRequest(query="ent", tags=WANTED)
    return search.filtered_images(c.images, c.ocr_texts, c.tags, request).select("id", "filename")


FOUND = f"(select id from images where id in (select image_id from ocr_texts where {UPPER} like '%ENT%' escape '\\'))"


def _found(c: Catalogue) -> DataFrame:
    return search.filtered_images(c.images, c.ocr_texts, c.tags, search.SearchRequest(query="ent"))


@query(f"select key, value, count(image_id) as count from tags where image_id in {FOUND} group by key, value", "images ocr_texts tags")
def facet_counts(c: Catalogue) -> DataFrame:
    return search.facet_counts(c.tags, _found(c))


@query(f"""select key as name, row_number() over (partition by key order by value) - 1 as pos, value, count(image_id)::double as count
from tags where image_id in {FOUND} group by key, value""", "images ocr_texts tags")
def facet_nested(c: Catalogue) -> DataFrame:
    nested = search.nested_facets(search.facet_counts(c.tags, _found(c)))
    return nested.select("name", F.posexplode("buckets").alias("pos", "b")).select("name", F.col("pos").cast("long").alias("pos"), "b.value", "b.count")


@query("""select key, value, count(image_id) as count, concat(value, ' (', count(image_id)::varchar, ')') as label
from tags where contains(lower(value), 'rc1') group by key, value""", "tags")
def facet_bucket_search(c: Catalogue) -> DataFrame:
    return search.bucket_search(search.facet_counts(c.tags, c.images), "RC1")


@query("select id, filename, created_at from images order by created_at desc, id desc limit 21", "images")
def page_first(c: Catalogue) -> DataFrame:
    return search.page(c.images, 20)


@query("""select id, filename, created_at from images where (created_at, id) < (timestamp '2024-01-03', 150)
order by created_at desc, id desc limit 21""", "images")
def page_next(c: Catalogue) -> DataFrame:
    return search.page(c.images, 20, search.Cursor(AT, 150))


@query("""select id, filename, created_at from images
where (created_at, id) < (select (created_at, id) from images order by created_at desc, id desc limit 1 offset 20)
order by created_at desc, id desc limit 21""", "images")
def page_next_reference_cursor(c: Catalogue) -> DataFrame:
    last = search.page(c.images, 20).collect()[-1]  # a page has 101 rows at most
    cursor = search.decode_cursor(search.encode_cursor(search.Cursor(last["created_at"], last["id"])))
    return search.page(c.images, 20, search.Cursor(cursor.created_at, int(cursor.id)))


PAGE = "(select id from images order by created_at desc, id desc limit 21)"


def _page(c: Catalogue) -> DataFrame:
    return search.hydrate(search.page(c.images, 20), c.ocr_texts, c.tags)


@query(f"""select image_id as id, concat('/api/images/', image_id::varchar) as "imageUrl", concat(text, ' (', confidence::varchar, ')') as line
from ocr_texts where confidence > 0.8 and image_id in {PAGE}""", "images ocr_texts")
def hydrate_texts(c: Catalogue) -> DataFrame:
    return _page(c).select("id", "imageUrl", F.explode("text").alias("line"))


@query(f"""select image_id as id, value as name, key as category, 1.0::double as score, source from tags where image_id in {PAGE}""", "images tags")
def hydrate_tags(c: Catalogue) -> DataFrame:
    return search.shown_tags(_page(c)).select("id", F.inline("tags"))


@query("""select '7' as id, '/api/images/7' as "imageUrl", filename as "originalFileName",
(select string_agg(text, '|' order by text) from ocr_texts where image_id = 7) as texts,
(select string_agg(concat(key, ':', value), '|' order by key, value) from tags where image_id = 7) as tags
from images where id = 7""", "images ocr_texts tags")
def item_detail(c: Catalogue) -> DataFrame:
    item = search.item_detail(c.images, c.ocr_texts, c.tags, 7)
    tags = F.sort_array(F.transform("tags", lambda t: F.struct(t["category"], t["name"])))
    joined = F.array_join(F.transform(tags, lambda t: F.concat(t["category"], F.lit(":"), t["name"])), "|")
    return item.select("id", "imageUrl", "originalFileName", F.array_join(F.sort_array("text"), "|").alias("texts"), joined.alias("tags"))


@query("select id, name from concepts", "concepts")
def concept_list(c: Catalogue) -> DataFrame:
    return c.concepts.select("id", "name")


@query("select id, name from concepts where id = 3", "concepts")
def concept_by_id(c: Catalogue) -> DataFrame:
    row = tables.one(tables.by_id(c.concepts, CONCEPT).select("id", "name"))
    return c.spark.createDataFrame([row], "id long, name string")


@query("select filename from images where id = 5", "images")
def image_filename(c: Catalogue) -> DataFrame:
    row = tables.one_or_none(tables.by_id(c.images, 5).select("filename"))
    return c.spark.createDataFrame([row] if row else [], "filename string")


def _tag_sql(source_sql: str, triples: list[tuple[str, str, str]], test: str, name: str) -> str:
    values = ", ".join(f"('{t}', '{k}', '{v}')" for t, k, v in triples)
    return f"""select distinct image_id, key, value, '{name}' as source
from {source_sql}, (values {values}) as r(token, key, value) where {test}"""


@query(_tag_sql("(select * from ocr_texts where confidence >= 0.4)", rules.flatten(WORDS), "contains(lower(text), token)", "OCR"), "ocr_texts")
def tags_from_ocr(c: Catalogue) -> DataFrame:
    return rules.tags_from_ocr(c.ocr_texts, rules.flatten(WORDS))


EDGE = r"[^\p{L}\p{N}_\p{M}]"


@query(_tag_sql("descriptions", rules.flatten(WORD_RULES), f"regexp_matches(text, '(^|{EDGE})' || token || '($|{EDGE})', 'i')", "Ollama"), "descriptions")
def tags_from_descriptions(c: Catalogue) -> DataFrame:
    return rules.tags_from_descriptions(c.descriptions, rules.flatten(WORD_RULES))


@query("select count(distinct image_id) as tagged_images from tags where source = 'Ollama'", "tags")
def tagged_image_count(c: Catalogue) -> DataFrame:
    return rules.tagged_images(c.tags.filter("source = 'Ollama'"))


NAMED = ", ".join(f"('{n}', '{t}')" for n, ts in NAMES.items() for t in ts)


@query(f"""select filename, string_agg(distinct name, ',' order by name) as names
from ocr_texts o join images i on i.id = o.image_id, (values {NAMED}) as r(name, token)
where confidence >= 0.4 and contains(lower(text), token) group by filename""", "images ocr_texts")
def rule_coverage(c: Catalogue) -> DataFrame:
    return rules.coverage(c.images, c.ocr_texts, NAMES).withColumn("names", F.array_join("names", ","))


@query(f"""select count(*) as total, count(*) filter (m) as matched, count(*) filter (e and not m) as no_rule, count(*) filter (o is null) as no_ocr
from images left join (select image_id as o, bool_or(confidence >= 0.4) as e,
  bool_or(confidence >= 0.4 and exists (select 1 from (values {NAMED}) as r(name, token) where contains(lower(text), token))) as m
  from ocr_texts group by image_id) on o = id""", "images ocr_texts")
def rule_coverage_summary(c: Catalogue) -> DataFrame:
    return rules.coverage_summary(c.images, c.ocr_texts, NAMES)


@query("select id, filename from images where id not in (select image_id from ocr_texts)", "images ocr_texts")
def images_without_ocr(c: Catalogue) -> DataFrame:
    return rules.without_ocr(c.images, c.ocr_texts).select("id", "filename")


def _files(c: Catalogue) -> DataFrame:
    return c.images.filter("filename not like 'src3/%'").select("filename")


@query("select id, filename from images where filename like 'src3/%'", "images")
def files_missing(c: Catalogue) -> DataFrame:
    return tables.missing_files(c.images, _files(c)).select("id", "filename")


@query("""select count(*) filter (filename not like 'src3/%') as size_a, count(*) filter (filename like '%1.jpg') as size_b,
count(*) filter (filename not like 'src3/%' and filename like '%1.jpg') as size_both from images""", "images")
def listing_intersection(c: Catalogue) -> DataFrame:
    return tables.shared_names(_files(c), c.images.filter("filename like '%1.jpg'"))


@query("select count(distinct filename) as registered from images", "images")
def registered_files(c: Catalogue) -> DataFrame:
    return c.images.select("filename").distinct().agg(F.count(F.lit(1)).alias("registered"))


@query("""select 'images' as name, count(*) as rows from images where filename not like 'src3/%'
union all select 'ocr_texts', count(*) from ocr_texts where image_id not in (select id from images where filename like 'src3/%')
union all select 'tags', count(*) from tags where image_id not in (select id from images where filename like 'src3/%')
union all select 'embeddings', count(*) from vectors where image_id not in (select id from images where filename like 'src3/%')""", "images ocr_texts tags vectors")
def unregister_cascade(c: Catalogue) -> DataFrame:
    gone = tables.missing_files(c.images, _files(c)).select("id")
    children = {"ocr_texts": c.ocr_texts, "tags": c.tags, "embeddings": c.vectors}
    out = None
    for name, df in tables.unregistered(c.images, children, gone).items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


MEMBERS = "select s.concept_id, r.embedding from refs r join sets s on r.concept_image_set_id = s.id"
CENTRE = f"""m as ({MEMBERS}), e as (select concept_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as pos from m),
a as (select concept_id, pos, avg(x) as x from e group by concept_id, pos),
centre as (select concept_id, list(x / l order by pos) as c from a join
  (select concept_id, sqrt(sum(x * x)) as l from a group by concept_id) using (concept_id) group by concept_id)"""


def _members(c: Catalogue) -> DataFrame:
    sets = c.concept_image_sets.select(F.col("id").alias("concept_image_set_id"), "concept_id", F.col("name").alias("subset"))
    return c.concept_images.join(sets, "concept_image_set_id")


@query(over("sets refs", "").rstrip() + f""", {CENTRE}
select concept_id, unnest(range(len(c))) as pos, round(unnest(c), 6) as x from centre""")
def concept_centroid(c: Catalogue) -> DataFrame:
    found = concepts.centroids(_members(c), ["concept_id"])
    return found.select("concept_id", F.posexplode("centroid").alias("pos", "x")).select(
        "concept_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


@query(over("sets refs", "").rstrip() + f""", {CENTRE}
select concept_id, round(avg(list_dot_product(embedding, c)), 6) as mean_similarity,
round(stddev_pop(list_dot_product(embedding, c)), 6) as std_similarity from m join centre using (concept_id) group by concept_id""")
def concept_similarity_stats(c: Catalogue) -> DataFrame:
    return rounded(concepts.similarity_stats(_members(c), ["concept_id"]), "mean_similarity", "std_similarity")


SUBSETS = CENTRE.replace("select s.concept_id, r.embedding", "select concat('c', s.concept_id::varchar) as concept_id, r.embedding").replace(
    "concept_image_set_id = s.id)",
    """concept_image_set_id = s.id union all
  select concat('c', s.concept_id::varchar, ':', s.name), r.embedding from refs r join sets s on r.concept_image_set_id = s.id)""",
)


@query(over("sets refs", "").rstrip() + f""", {SUBSETS}
select concept_id as concept, round(avg(list_dot_product(embedding, c)), 6) as mean_similarity,
round(stddev_pop(list_dot_product(embedding, c)), 6) as std_similarity from m join centre using (concept_id) group by concept_id""")
def concept_report(c: Catalogue) -> DataFrame:
    named = _members(c).withColumn("concept", F.concat(F.lit("c"), F.col("concept_id").cast("string")))
    return rounded(concepts.concept_report(named), "mean_similarity", "std_similarity")


def _concept_vectors(c: Catalogue) -> DataFrame:
    centre = concepts.centroids(_members(c), ["concept_id"])
    return centre.select(F.concat(F.lit("label_"), F.col("concept_id").cast("string")).alias("name"), F.col("centroid").alias("embedding"))


PAIRS = f""", {CENTRE}
select concat('label_', a.concept_id::varchar) as name1, concat('label_', b.concept_id::varchar) as name2,
list_dot_product(a.c, b.c) as similarity from centre a join centre b on a.concept_id <> b.concept_id"""


@query(over("sets refs", "").rstrip() + PAIRS.replace("select concat(", ", p as (select concat(", 1) + """)
select name1 as name, round(max(similarity), 6) as max_similarity from p group by name1""")
def concept_assessment_max(c: Catalogue) -> DataFrame:
    return rounded(concepts.assessment_max(_concept_vectors(c)), "max_similarity")


@query(over("sets refs", "").rstrip() + PAIRS.replace("select concat(", ", p as (select concat(", 1) + """)
select name1, name2, round(similarity, 6) as similarity from p where similarity > 0.05""")
def concept_assessment_pairs(c: Catalogue) -> DataFrame:
    return rounded(concepts.assessment_pairs(_concept_vectors(c), 0.05), "similarity")


@query("""select a.id as a, b.id as b, round(list_dot_product(a.embedding, b.embedding), 6) as similarity
from vectors a join vectors b on a.id < b.id where list_dot_product(a.embedding, b.embedding) > 0.4""", "vectors")
def close_vector_pairs(c: Catalogue) -> DataFrame:
    return rounded(concepts.close_pairs(c.vectors, 0.4), "similarity")


TEMPLATES = ["{} on a shelf", "a poster about {}", "{} as a drawing"]


@query(" union all ".join(f"select concat('c', label::varchar) as concept, concat('thing ', label::varchar) as text, replace('{t}', '{{}}', concat('thing ', label::varchar)) as prompt from (select distinct label from embeddings)" for t in TEMPLATES))
def prompt_product(c: Catalogue) -> DataFrame:
    named = c.concepts.select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("concept"), F.concat(F.lit("thing "), F.col("id").cast("string")).alias("text")
    )
    return concepts.prompts(named, TEMPLATES)


@query("""select id, unnest(range(8)) as pos, round(unnest(list_transform(embedding[1:8], lambda x: exp(x) / list_sum(list_transform(embedding[1:8], lambda y: exp(y))))), 6) as p
from vectors""", "vectors")
def softmax_scores(c: Catalogue) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    return c.vectors.select("id", F.posexplode(vectors.softmax(logits)).alias("pos", "p")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.round("p", 6).alias("p")
    )


@query(over("vectors sets refs", "").rstrip() + f""", {CENTRE}
select v.image_id, concat('label_', concept_id::varchar) as prompt, round(100 * list_dot_product(v.embedding, c), 4) as score
from vectors v, centre where 100 * list_dot_product(v.embedding, c) > 30""")
def prompt_scores(c: Catalogue) -> DataFrame:
    prompts = _concept_vectors(c).select(F.col("name").alias("prompt"), F.col("embedding").alias("prompt_embedding"))
    return concepts.prompt_scores(c.vectors, prompts).withColumn("score", F.round("score", 4))


KINDS = ["image/jpeg", "IMAGE/PNG; charset=x", "text/html", "image/WebP"]


@query("""select id, case id % 4 when 0 then '.jpg' when 1 then '.png' when 2 then '.bin' else '.webp' end as ext,
replace(lower(concat('Top Ten ', filename)), ' ', '-') as slug from images""", "images")
def names_and_extensions(c: Catalogue) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("id") % 4 + 1).cast("int"))
    return c.images.select("id", text.extension(kind).alias("ext"), text.slug(F.concat(F.lit("Top Ten "), "filename")).alias("slug"))


@query("""select id, case when greatest(w, h) > 1600 then trunc(w * (1600.0::double / greatest(w, h)))::int else w end as width,
case when greatest(w, h) > 1600 then trunc(h * (1600.0::double / greatest(w, h)))::int else h end as height
from (select id, (id * 37 % 3000 + 1)::int as w, (id * 91 % 2500 + 1)::int as h from images)""", "images")
def resize_dims(c: Catalogue) -> DataFrame:
    w, h = (F.col("id") * 37 % 3000 + 1).cast("int"), (F.col("id") * 91 % 2500 + 1).cast("int")
    return c.images.select("id", text.bounded_side(w, h).alias("width"), text.bounded_side(h, w).alias("height"))


EVENTS = """select user_id::varchar as image_id, event_type as pipeline, arg_max(case when value < 10 then 'failed' when value < 20 then 'done' else 'processing' end, (ts, event_id)) as status
from events group by user_id, event_type"""


@query(EVENTS)
def ingestion_status(c: Catalogue) -> DataFrame:
    state = F.when(F.col("value") < 10, ingest.FAILED).when(F.col("value") < 20, ingest.DONE).otherwise(ingest.PROCESSING)
    rows = c.table("events").select(
        F.col("user_id").cast("string").alias("image_id"), F.col("event_type").alias("pipeline"), state.alias("status"),
        F.struct("ts", "event_id").alias("started_at"),
    )
    return ingest.latest_status(rows).select("image_id", "pipeline", "status")


@query(f"""select id, filename from images where id::varchar not in (select image_id from ({EVENTS}) where pipeline = 'click' and status in ('done', 'processing'))""", "images")
def claimable_images(c: Catalogue) -> DataFrame:
    status = QUERIES["ingestion_status"](c.spark, c.folder)
    images = c.images.select(F.col("id").cast("string").alias("id"), "filename")
    return ingest.claimable(images, status, "click").select(F.col("id").cast("long").alias("id"), "filename")


@query("""select user_id as image_id, round(arg_max(value, (ts, event_id)) * 3, 6) as total_time_ms from events group by user_id""")
def metrics_latest(c: Catalogue) -> DataFrame:
    rows = c.table("events").select(
        F.col("user_id").alias("image_id"), F.struct("ts", "event_id").alias("created_at"),
        *(F.col("value").alias(f"{x}_time_ms") for x in ("read", "preprocess", "ocr")),
    )
    return ingest.latest_metrics(rows).select("image_id", F.round("total_time_ms", 6).alias("total_time_ms"))


@query("""select id, round(list(d order by d)[5], 5) as core
from (select v.id, list_distance(v.embedding, w.embedding) as d from vectors v, vectors w) group by id""", "vectors")
def core_distances(c: Catalogue) -> DataFrame:
    found = cluster.core_distances(c.vectors.select("id", F.col("embedding").alias("vector")), 5)
    return found.withColumn("core", F.round("core", 5))


@query()
def cluster_labels(c: Catalogue) -> DataFrame:
    return cluster.hdbscan(c.vectors)


@query()
def cluster_summary(c: Catalogue) -> DataFrame:
    return cluster.cluster_summary(cluster.hdbscan(c.vectors))


WITHIN = "(select id from images where id in (select image_id from tags where key = 'lang' and value in ('fr', 'de')))"


@query(f"""with_page as (select id, filename, created_at, row_number() over (order by created_at desc, id desc) - 1 as pos
  from images where id in {WITHIN} order by created_at desc, id desc limit 21)
select 'item' as part, pos, concat('/api/images/', id::varchar) as name, filename as value, 0::double as count,
  (select count(*) from ocr_texts o where o.image_id = p.id and confidence > 0.8) as texts, (select count(*) from tags t where t.image_id = p.id) as tags
from with_page p where pos < 20
union all select 'facet', row_number() over (partition by key order by value) - 1, key, value, count(*)::double, 0, 0
from tags where image_id in {WITHIN} group by key, value
union all select 'next', 0, max(id::varchar) filter (pos = 20), case when count(*) > 20 then 'true' else 'false' end, 0, 0, 0 from with_page""".replace("with_page as", ", with_page as", 1), "images ocr_texts tags")
def search_response(c: Catalogue) -> DataFrame:
    """A whole response, of a request that went through the form it has in a URL."""
    request = search.from_url(search.to_url(search.SearchRequest(tags={"lang": {"fr", "de"}}, limit=20)))
    found = search.search(c.images, c.ocr_texts, c.tags, request)
    following, zero = search.decode_cursor(found.next_cursor), F.lit(0).cast("long")
    order = Window.orderBy(F.desc_nulls_first("created_at"), F.desc("id"))  # of a page
    at = c.images.select(F.col("id").cast("long").alias("id"), "created_at")
    items = found.items.join(at, "id").withColumn("pos", F.row_number().over(order) - 1).select(
        F.lit("item").alias("part"), F.col("pos").cast("long").alias("pos"), F.col("imageUrl").alias("name"), F.col("originalFileName").alias("value"),
        F.lit(0.0).alias("count"), F.size("text").cast("long").alias("texts"), F.size("tags").cast("long").alias("tags"),
    )
    facets = found.facets.select("name", F.posexplode("buckets").alias("pos", "b")).select(
        F.lit("facet").alias("part"), F.col("pos").cast("long").alias("pos"), "name", "b.value", "b.count", zero.alias("texts"), zero.alias("tags")
    )
    last = ("next", 0, str(following.id) if following else None, str(found.has_next).lower(), 0.0, 0, 0)
    return items.unionByName(facets).unionByName(c.spark.createDataFrame([last], items.schema))


@query("select 0::bigint as items, false as has_next")
def search_short_query(c: Catalogue) -> DataFrame:
    found = search.search(c.images, c.ocr_texts, c.tags, search.SearchRequest(query="e", least_query=3))
    return found.items.agg(F.count(F.lit(1)).alias("items")).withColumn("has_next", F.lit(found.has_next))


@query("""select count(*) as items, count(distinct id) as images, sum(id)::bigint as ids from images
where id in (select image_id from tags where key = 'quality' and value = '0')""", "images tags")
def search_scroll(c: Catalogue) -> DataFrame:
    """All pages of a search, one after the other."""
    request = search.SearchRequest(tags={"quality": {"0"}}, limit=100, cursor_from="returned")
    out = None
    for response in search.scroll(c.images, c.ocr_texts, c.tags, request):
        ids = response.items.select(F.col("id").cast("long").alias("id"))
        out = ids if out is None else out.unionByName(ids)
    return out.agg(F.count(F.lit(1)).alias("items"), F.countDistinct("id").alias("images"), F.sum("id").alias("ids"))


@query(_tag_sql("(select * from descriptions where image_id in (select id from images where id % 3 = 0))", rules.flatten(WORD_RULES), f"regexp_matches(text, '(^|{EDGE})' || token || '($|{EDGE})', 'i')", "Ollama"), "images descriptions")
def tags_of_known_images(c: Catalogue) -> DataFrame:
    """Descriptions of images that are not there give no tags."""
    return rules.tags_from_descriptions(c.descriptions, rules.flatten(WORD_RULES), c.images.filter("id % 3 = 0"))


def _contents(c: Catalogue) -> DataFrame:
    """Texts of documents in place of files; a reader of theirs fails on some."""
    return c.table("documents").select(F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _decode(content: bytes):
    if len(content) % 7 == 0:
        raise ValueError("broken")
    return content, len(content), 2 * len(content)


def _first(content: bytes):
    return [([(0, 0), (len(content), 1)], content[:1].decode("utf-8", "replace"), 0.5)]


def _sizes(content: bytes):
    return [([(0, 0), (1, 1)], str(len(content)), 0.25)] * 2


BYTES = "(select doc_id::varchar as image_id, octet_length(encode(coalesce(text, ''))) as n from documents)"


@query(f"""select image_id, language, count(*) as texts, round(avg(confidence), 6) as confidence, max(x) as width
from (select image_id, 'en' as language, 0.5 as confidence, n::double as x from {BYTES} where n % 7 <> 0
  union all select image_id, 'ru', 0.25, 1 from {BYTES}, range(2) where n % 7 <> 0) group by image_id, language""")
def recognised_texts(c: Catalogue) -> DataFrame:
    outcomes = ingest.recognise(_contents(c), _decode, {"en": _first, "ru": _sizes}, "ocr")
    texts = ingest.recognised_tables(outcomes, "ocr")["ocr_texts"]
    return texts.groupBy("image_id", "language").agg(
        F.count(F.lit(1)).alias("texts"), F.round(F.avg("confidence"), 6).alias("confidence"), F.max(F.col("bbox")[1][0]).alias("width")
    )


@query(f"""select image_id, 'ocr' as pipeline, case when n % 7 = 0 then 'failed' else 'done' end as status,
case when n % 7 = 0 then 'ValueError: broken' end as error_message from {BYTES}""")
def recognition_status(c: Catalogue) -> DataFrame:
    outcomes = ingest.recognise(_contents(c), _decode, {"en": _first}, "ocr")
    return ingest.recognised_tables(outcomes, "ocr")["image_processing_status"].select("image_id", "pipeline", "status", "error_message")


def _shape(contents: list[bytes]):
    if any(len(x) % 11 == 0 for x in contents):
        raise ValueError("broken")
    return [(len(x) % 5, len(x) % 3, 2) for x in contents]


@query(f"""select image_id, round((n % 5) / s, 4) as x, round((n % 3) / s, 4) as y, round(2 / s, 4) as z, case when n % 11 = 0 then 'ValueError: broken' end as error_message
from (select *, case when n % 11 <> 0 then sqrt((n % 5) * (n % 5) + (n % 3) * (n % 3) + 4) end as s from {BYTES})""")
def embedding_job(c: Catalogue) -> DataFrame:
    """Vectors of length 1 from a model that takes batches and fails on some contents."""
    parts = {name: F.round(F.col("embedding")[i].cast("double"), 4) for i, name in enumerate("xyz")}
    return ingest.embed(_contents(c), _shape).select("image_id", *(v.alias(k) for k, v in parts.items()), "error_message")


@query(f"""select image_id, case when n % 7 <> 0 then concat(n::varchar, ' bytes') end as text, case when n % 7 = 0 then 'ValueError: broken' end as message from {BYTES}""")
def description_job(c: Catalogue) -> DataFrame:
    found = ingest.describe(_contents(c), lambda content: f"{_decode(content)[1]} bytes")
    errors = found["processing_errors"].select("image_id", F.lit(None).cast("string").alias("text"), "message")
    return found["descriptions"].withColumn("message", F.lit(None).cast("string")).unionByName(errors)


GIVEN = """given as (select concat('c', s.concept_id::varchar) as concept, case when s.id % 2 = 1 then s.name end as subset, r.filename, r.embedding
  from refs r join sets s on r.concept_image_set_id = s.id),
places as (select concept, coalesce(subset, 'main') as name, count(*) as n from given group by all),
every as (select distinct concept, 'main' as name from given union select concept, name from places),
numbered as (select concept, name, coalesce(n, 0) as n, row_number() over (order by concept, name) as id,
  dense_rank() over (order by concept) as concept_id from every left join places using (concept, name)),
m as (select concept, 'main' as name, embedding from given union all select concept, subset, embedding from given where subset is not null),
e as (select concept, name, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from m),
a as (select concept, name, pos, avg(x) as x from e group by all),
centre as (select concept, name, list(x order by pos)[1] / sqrt(sum(x * x)) as first from a group by concept, name)"""


def _given(c: Catalogue) -> DataFrame:
    sets = c.concept_image_sets.select(
        F.col("id").alias("concept_image_set_id"), F.concat(F.lit("c"), F.col("concept_id").cast("string")).alias("concept"),
        F.when(F.col("id") % 2 == 1, F.col("name")).alias("subset"),
    )
    return c.concept_images.join(sets, "concept_image_set_id").select("concept", "subset", "filename", "embedding")


@query(over("sets refs", "").rstrip() + f""", {GIVEN}
select id::int as id, concept_id::int as concept_id, concept, name, round(first, 5) as first from numbered join centre using (concept, name)""")
def concept_set_table(c: Catalogue) -> DataFrame:
    made = concepts.image_concept_tables(_given(c))
    named = made["concepts"].select(F.col("id").alias("concept_id"), F.col("name").alias("concept"))
    sets = made["concept_image_sets"].join(named, "concept_id")
    return sets.select("id", "concept_id", "concept", "name", F.round(F.col("centroid_embedding")[0].cast("double"), 5).alias("first"))


@query(over("sets refs", "").rstrip() + f""", {GIVEN}
select (row_number() over (order by g.concept, n.name, g.filename))::int as id, n.id::int as concept_image_set_id, g.filename
from given g join numbered n on n.concept = g.concept and n.name = coalesce(g.subset, 'main')""")
def concept_image_table(c: Catalogue) -> DataFrame:
    return concepts.image_concept_tables(_given(c))["concept_images"].drop("embedding")


@query("""select filename from (select concat(filename, case when id % 3 = 0 then '.MP4' else '' end) as filename from images)
where filename not ilike '%.mp4'""", "images")
def files_without_videos(c: Catalogue) -> DataFrame:
    name = F.concat("filename", F.when(F.col("id") % 3 == 0, F.lit(".MP4")).otherwise(F.lit("")))
    return c.images.select(name.alias("filename")).filter(~text.is_video(F.col("filename")))


@query("""select image_id, key, value, source from tags where source <> 'OCR' union all
select image_id, key, value, source from tags where source = 'OCR' and image_id % 4 = 0""", "tags")
def tags_replaced_by_source(c: Catalogue) -> DataFrame:
    path = f"{scratch(c.spark)}/tags"
    tables.replace_sources(c.tags, path, ["OCR", "Ollama"])
    tables.replace_sources(c.tags.filter("source = 'OCR' and image_id % 4 = 0"), path, ["OCR"])
    return c.spark.read.parquet(path).select("image_id", "key", "value", "source")


@query("select id, count(*) as rows from concepts, range(2) group by id", "concepts")
def rows_added(c: Catalogue) -> DataFrame:
    """A full refresh and an insert after it."""
    path = f"{scratch(c.spark)}/concepts"
    tables.append(c.concepts, path)
    tables.replace_all(c.concepts, path)
    tables.append(c.concepts, path)
    return c.spark.read.parquet(path).groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


@query("select id, name from concepts", "concepts")
def report_read_back(c: Catalogue) -> DataFrame:
    path = f"{scratch(c.spark)}/report"
    tables.report(c.concepts, path, F.asc("id"))
    files = tables.listing(c.spark, path).filter(F.endswith("filename", F.lit(".csv")))
    contents = tables.file_bytes(c.spark, path, files.withColumn("id", F.lit(0)))
    lines = contents.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> '' and line <> 'id,name'")
    return lines.select(F.split_part("line", F.lit(","), F.lit(1)).cast("long").alias("id"), F.split_part("line", F.lit(","), F.lit(2)).alias("name"))


@query("""select id, p as pos, case p when 0 then id + 0.5 else 3 end::double as x, case p when 0 then 2 * id else 4 end::double as y
from images, (values (0::bigint), (1::bigint)) as t(p)""", "images")
def box_points(c: Catalogue) -> DataFrame:
    box = F.concat(F.lit("[["), (F.col("id") + 0.5).cast("string"), F.lit(","), (2 * F.col("id")).cast("string"), F.lit("],[3,4]]"))
    points = c.images.select("id", F.posexplode(text.polygon(box)).alias("pos", "p"))
    return points.select("id", F.col("pos").cast("long").alias("pos"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("""select id, case when id % 5 <> 0 then concat('No ', id::varchar) end as description, case when id % 5 <> 0 then concat('t', id::varchar) end as tag
from images""", "images")
def description_fields(c: Catalogue) -> DataFrame:
    """Fields of the JSON object in an answer; some answers have none."""
    i = F.col("id").cast("string")
    told = F.concat(F.lit('Here it is: {"description": "No '), i, F.lit('", "tags": ["t'), i, F.lit('"]} - done'))
    found = text.structured_description(F.when(F.col("id") % 5 == 0, F.lit("I cannot tell")).otherwise(told))
    return c.images.select("id", found.alias("d")).select("id", "d.description", F.get("d.tags", F.lit(0)).alias("tag"))
