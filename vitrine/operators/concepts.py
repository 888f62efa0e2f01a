"""Concept centroids, cohesion and separation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.vectors import Block, block_products, dot, normalise


def centroids(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(*keys, centroid, members): elementwise mean over its length. A mean of zero gives null elements.

    A group's members are summed in place by position, within tasks first.
    """
    by_place = vectors.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    mean = by_place.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p"), F.max("n").alias("members"))
    plain = mean.withColumn("mean", F.transform("p", lambda x: x["m"]))
    return plain.select(*keys, normalise(F.col("mean")).alias("centroid"), "members")


def similarity_stats(vectors: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(*keys, mean_similarity, std_similarity) of members to their group's centroid, by population deviation."""
    joined = vectors.join(centroids(vectors, keys, vector), keys)
    similar = dot(F.col(vector), F.col("centroid"))
    return joined.groupBy(*keys).agg(F.avg(similar).alias("mean_similarity"), F.stddev_pop(similar).alias("std_similarity"))


def concept_report(vectors: DataFrame, concept: str = "concept", subset: str = "subset") -> DataFrame:
    """(concept, mean_similarity, std_similarity), best first: concepts over all their vectors and ``concept:subset`` for
    each subset that is named."""
    whole = similarity_stats(vectors, [concept]).withColumnRenamed(concept, "concept")
    parts = similarity_stats(vectors.filter(F.col(subset).isNotNull()), [concept, subset])
    parts = parts.select(F.concat(concept, F.lit(":"), subset).alias("concept"), "mean_similarity", "std_similarity")
    return whole.unionByName(parts).orderBy(F.desc("mean_similarity"), "concept")


def image_concept_tables(vectors: DataFrame) -> dict[str, DataFrame]:
    """``concepts``, ``concept_image_sets`` and ``concept_images`` from (concept, subset, filename, embedding).

    Vectors of no subset belong to their concept's set ``main``. Its centroid, as the concept's, is that of all the
    concept's vectors; a subset's is its own. Ids count from 1 by name, images within the range of their set.
    """
    named = vectors.withColumn("set", F.coalesce("subset", F.lit("main")))
    whole = centroids(vectors, ["concept"]).select("concept", F.col("centroid").alias("embedding"))
    own = centroids(vectors.filter(F.col("subset").isNotNull()), ["concept", "subset"])
    sets = whole.select("concept", F.lit("main").alias("set"), F.col("embedding").alias("centroid_embedding")).unionByName(
        own.filter("subset <> 'main'").select("concept", F.col("subset").alias("set"), F.col("centroid").alias("centroid_embedding"))
    )
    concepts = whole.withColumn("id", F.row_number().over(Window.orderBy("concept")))  # a row a concept
    counts = named.groupBy("concept", "set").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("concept", "set")  # a row a set
    placed = sets.join(counts, ["concept", "set"], "left").withColumns({
        "set_id": F.row_number().over(before),
        "start": F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    inside = F.row_number().over(Window.partitionBy("concept", "set").orderBy("filename"))
    members = named.withColumn("place", inside).join(placed.select("concept", "set", "set_id", "start"), ["concept", "set"])
    floats = "array<float>"
    return {
        "concepts": concepts.select("id", F.col("concept").alias("name"), F.col("embedding").cast(floats).alias("embedding")),
        "concept_image_sets": placed.join(concepts.select("concept", "id"), "concept").select(
            F.col("set_id").alias("id"), F.col("id").alias("concept_id"), F.col("set").alias("name"),
            F.when(F.col("set") == "main", F.col("concept")).otherwise(F.col("set")).alias("directory"),
            F.col("centroid_embedding").cast(floats).alias("centroid_embedding"),
        ),
        "concept_images": members.select(
            (F.col("start") + F.col("place")).cast("int").alias("id"), F.col("set_id").alias("concept_image_set_id"), "filename",
            F.col("embedding").cast(floats).alias("embedding"),
        ),
    }


def text_concepts(texts: DataFrame, templates: list[str], embed) -> DataFrame:
    """Centroids of prompts: every template with every text of a concept, embedded by ``embed(DataFrame)``."""
    return centroids(embed(prompts(texts, templates)), ["concept"])


def prompts(texts: DataFrame, templates: list[str]) -> DataFrame:
    """(concept, text, prompt): templates hold ``{}`` where the text goes."""
    filled = F.array(*(F.replace(F.lit(t), F.lit("{}"), F.col("text")) for t in templates))
    return texts.select("concept", "text", F.explode(filled).alias("prompt"))


def _products(left: DataFrame, right: DataFrame, threshold: float | None, scale: float = 1.0) -> DataFrame:
    """(a, b, score) of the pairs of two sets (id, vector) with a scaled product of more than the threshold, if there is one."""

    def keep(a: Block, b: Block) -> pd.DataFrame:
        score = (a.rows @ b.rows.T) * scale
        i, j = np.nonzero(~np.isnan(score) if threshold is None else score > threshold)
        return pd.DataFrame({"a": a.ids[i], "b": b.ids[j], "score": score[i, j]})

    a, b = (df.schema["id"].dataType.simpleString() for df in (left, right))
    return block_products(left, right, keep, f"a {a}, b {b}, score double")


def assessment_max(concepts: DataFrame) -> DataFrame:
    """(name, max_similarity) to concepts of other names; a name that stands alone has no row."""
    rows = concepts.select(F.col("name").alias("id"), F.col("embedding").alias("vector"))
    return _products(rows, rows, None).filter("a <> b").groupBy(F.col("a").alias("name")).agg(F.max("score").alias("max_similarity"))


def assessment_pairs(concepts: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(name1, name2, similarity) of more than the threshold, both ways round."""
    rows = concepts.select(F.col("name").alias("id"), F.col("embedding").alias("vector"))
    found = _products(rows, rows, threshold).filter("a <> b")
    return found.select(F.col("a").alias("name1"), F.col("b").alias("name2"), F.col("score").alias("similarity"))


def close_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) with a < b of unit vectors with a product over the threshold, by block products."""
    rows = vectors.select("id", F.col("embedding").alias("vector"))
    return _products(rows, rows, threshold).filter("a < b").withColumnRenamed("score", "similarity")


def prompt_scores(image_vectors: DataFrame, prompt_vectors: DataFrame, scale: float = 100.0, threshold: float = 30.0) -> DataFrame:
    """(image_id, prompt, score) of scaled products of more than the threshold."""
    rows = image_vectors.select(F.col("image_id").alias("id"), F.col("embedding").alias("vector"))
    prompts = prompt_vectors.select(F.col("prompt").alias("id"), F.col("prompt_embedding").alias("vector"))
    return _products(rows, prompts, threshold, scale).select(F.col("a").alias("image_id"), F.col("b").alias("prompt"), "score")
