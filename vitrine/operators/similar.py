"""Exact similarity: nearest images, images of a concept, concepts of an image."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.vectors import Block, block_products, cosine_distance


def _literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def with_filenames(images: DataFrame, vectors: DataFrame) -> DataFrame:
    """(image_id, filename, embedding) of vectors that have an image."""
    return vectors.join(images.select(F.col("id").alias("image_id"), "filename"), "image_id").select("image_id", "filename", "embedding")


def nearest_images(images: DataFrame, vectors: DataFrame, vector: list[float], k: int = 10, without=None) -> DataFrame:
    """(image_id, filename, distance) of the k nearest; ties by id, NaN and null last; one image may appear twice."""
    rows = vectors if without is None else vectors.filter(F.col("image_id") != F.lit(without))
    near = rows.select("image_id", cosine_distance(F.col("embedding"), _literal(vector)).alias("distance"))
    joined = near.join(images.select(F.col("id").alias("image_id"), "filename"), "image_id")
    return joined.select("image_id", "filename", "distance").orderBy(F.asc_nulls_last("distance"), "image_id").limit(k)


def _close(vectors: DataFrame, references: DataFrame, threshold: float) -> DataFrame:
    """(id, key, n, least, total, score) of vectors (id, vector) and keyed references (id, vector) within threshold."""

    def keep(a: Block, b: Block) -> pd.DataFrame:
        d = 1 - np.clip(a.unit() @ b.unit().T, -1, 1)
        i, j = np.nonzero(d < threshold)
        d = d[i, j]
        pairs = pd.DataFrame({"id": a.ids[i], "key": b.ids[j], "d": d, "score": np.exp(-d)})
        return pairs.groupby(["id", "key"], as_index=False).agg(n=("d", "size"), least=("d", "min"), total=("d", "sum"), score=("score", "sum"))

    names = {"id": vectors.schema["id"].dataType.simpleString(), "key": references.schema["id"].dataType.simpleString()}
    parts = block_products(vectors, references, keep, f"id {names['id']}, key {names['key']}, n long, least double, total double, score double")
    return parts.groupBy("id", "key").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total"), F.sum("score").alias("score")
    )


def concept_vectors(concept_images: DataFrame, sets: DataFrame, concept_id) -> DataFrame:
    """(embedding) of a concept's reference images."""
    own = sets.filter(F.col("concept_id") == concept_id).select(F.col("id").alias("concept_image_set_id"))
    return concept_images.join(own, "concept_image_set_id").select(F.col("embedding").alias("reference"))


def concept_top_images(
    images: DataFrame, vectors: DataFrame, concept_images: DataFrame, sets: DataFrame, concept_id, threshold: float = 0.2, limit: int = 50
) -> DataFrame:
    """(image_id, filename, match_count, avg_distance, score) by falling score: sums of exp(-distance) within threshold."""
    references = concept_vectors(concept_images, sets, concept_id).select(F.lit(0).alias("id"), F.col("reference").alias("vector"))
    own = vectors.select(F.col("image_id").alias("id"), F.col("embedding").alias("vector"))
    near = _close(own, references, threshold).withColumnRenamed("id", "image_id")
    named = near.join(images.select(F.col("id").alias("image_id"), "filename"), "image_id")
    found = named.select("image_id", "filename", F.col("n").alias("match_count"), (F.col("total") / F.col("n")).alias("avg_distance"), "score")
    return found.orderBy(F.desc("score"), "image_id").limit(limit)


def _references(concept_images: DataFrame, sets: DataFrame, concepts: DataFrame) -> DataFrame:
    named = sets.select(F.col("id").alias("concept_image_set_id"), "concept_id", F.col("name").alias("set_name"))
    return concept_images.withColumnRenamed("id", "concept_image_id").join(named, "concept_image_set_id").join(
        concepts.select(F.col("id").alias("concept_id"), "name"), "concept_id"
    )


def image_top_concepts(
    concept_images: DataFrame, sets: DataFrame, concepts: DataFrame, vector: list[float], threshold: float = 0.2
) -> DataFrame:
    """(name, id, avg_distance) of the concepts with reference images within threshold, nearest first, all of them."""
    distance = cosine_distance(F.col("embedding"), _literal(vector))
    return (
        _references(concept_images, sets, concepts)
        .select("name", F.col("concept_id").alias("id"), distance.alias("distance"))
        .filter((F.col("distance") < threshold) & ~F.isnan("distance"))
        .groupBy("name", "id")
        .agg(F.avg("distance").alias("avg_distance"))
        .orderBy("avg_distance", "id")
    )


def nearest_references(
    concept_images: DataFrame, sets: DataFrame, concepts: DataFrame, vector: list[float], k: int = 10
) -> DataFrame:
    """(concept_image_id, id, name, set_id, set_name, distance) of the k nearest reference images; concepts may repeat."""
    distance = cosine_distance(F.col("embedding"), _literal(vector))
    return (
        _references(concept_images, sets, concepts)
        .select(
            "concept_image_id", F.col("concept_id").alias("id"), "name", F.col("concept_image_set_id").alias("set_id"), "set_name", distance.alias("distance"),
        )
        .orderBy(F.asc_nulls_last("distance"), "concept_image_id")
        .limit(k)
    )


def match_counts(images: DataFrame, vectors: DataFrame, concept_images: DataFrame, sets: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(image_id, concept_id, matches, least_distance): how often each image meets each concept within threshold."""
    named = sets.select(F.col("id").alias("concept_image_set_id"), "concept_id")
    references = concept_images.join(named, "concept_image_set_id").select(F.col("concept_id").alias("id"), F.col("embedding").alias("vector"))
    known = vectors.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    near = _close(known.select(F.col("image_id").alias("id"), F.col("embedding").alias("vector")), references, threshold)
    return near.select(
        F.col("id").alias("image_id"), F.col("key").alias("concept_id"), F.col("n").alias("matches"), F.col("least").alias("least_distance")
    )
