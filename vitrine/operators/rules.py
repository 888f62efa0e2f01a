"""Tags and coverage from token rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import contains_token, holds_word

Matcher = Callable[[Column, str], Column]


def flatten(rules: Mapping[str, str | Mapping[str, str | list[str]]]) -> list[tuple[str, str, str]]:
    """(token, key, value) rows of rules; a rule that is a string stands for another rule, through any number of steps.

    A chain that comes back to itself or ends at no rule is an error.
    """
    out = []
    for token, rule in rules.items():
        passed = {token}
        while isinstance(rule, str):
            if rule in passed:
                raise ValueError(f"rules of {token!r} run in a circle")
            if rule not in rules:
                raise KeyError(rule)
            passed.add(rule)
            rule = rules[rule]
        for key, values in rule.items():
            out += [(token, key, v) for v in ([values] if isinstance(values, str) else values)]
    return out


def hits(texts: DataFrame, tokens: list[str], matcher: Matcher) -> DataFrame:
    """texts with a row per token (column ``token``) that matches.

    The tests are literals of one projection: there is no join, and each pattern is compiled once a task.
    """
    found = [F.when(matcher(F.col("text"), t), F.lit(t)) for t in dict.fromkeys(tokens)]
    return texts.withColumn("token", F.explode(F.array_compact(F.array(*found)))) if found else texts.limit(0).withColumn("token", F.lit(""))


def derive_tags(texts: DataFrame, rules: list[tuple[str, str, str]], matcher: Matcher, source: str) -> DataFrame:
    """(image_id, key, value, source): each tag once an image, from all its texts and all matching rules."""
    of_token: dict[str, list[tuple[str, str]]] = {}
    for token, key, value in rules:
        of_token.setdefault(token, []).append((key, value))
    tags = F.create_map(
        *(x for t, kv in of_token.items() for x in (F.lit(t), F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in kv))))
    )
    found = hits(texts.select("image_id", "text"), list(of_token), matcher)
    pairs = found.select("image_id", F.explode(tags[F.col("token")]).alias("t")) if of_token else None
    if pairs is None:
        return found.select("image_id", F.lit("").alias("key"), F.lit("").alias("value"), F.lit(source).alias("source"))
    return pairs.select("image_id", "t.key", "t.value").distinct().withColumn("source", F.lit(source))


def of_images(texts: DataFrame, images: DataFrame | None) -> DataFrame:
    """The texts whose image is there; all of them where no images are given."""
    return texts if images is None else texts.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def tags_from_ocr(ocr: DataFrame, rules: list[tuple[str, str, str]], least: float = 0.4, images: DataFrame | None = None) -> DataFrame:
    """Substring rules over recognised texts of at least the least confidence; texts without one are left out."""
    return derive_tags(of_images(ocr.filter(F.col("confidence") >= least), images), rules, contains_token, "OCR")


def tags_from_descriptions(descriptions: DataFrame, rules: list[tuple[str, str, str]], images: DataFrame | None = None) -> DataFrame:
    """Whole-word rules over generated descriptions."""
    return derive_tags(of_images(descriptions, images), rules, holds_word, "Ollama")


def tagged_images(tags: DataFrame) -> DataFrame:
    return tags.agg(F.countDistinct("image_id").alias("tagged_images"))


def coverage(images: DataFrame, ocr: DataFrame, names: Mapping[str, list[str]], least: float = 0.4) -> DataFrame:
    """(filename, names): the names of which any token stands in an image's eligible texts."""
    of_token = {t: [n for n, ts in names.items() if t in ts] for ts in names.values() for t in ts}
    named = F.create_map(*(x for t, ns in of_token.items() for x in (F.lit(t), F.array(*map(F.lit, ns)))))
    found = hits(ocr.filter(F.col("confidence") >= least).select("image_id", "text"), list(of_token), contains_token)
    per_image = found.select("image_id", F.explode(named[F.col("token")]).alias("name")).distinct()
    files = images.select(F.col("id").alias("image_id"), "filename")
    return per_image.join(files, "image_id").groupBy("filename").agg(F.sort_array(F.collect_set("name")).alias("names"))


def without_ocr(images: DataFrame, ocr: DataFrame) -> DataFrame:
    return images.join(ocr.select(F.col("image_id").alias("id")), "id", "left_anti")


def coverage_summary(images: DataFrame, ocr: DataFrame, names: Mapping[str, list[str]], least: float = 0.4) -> DataFrame:
    """One row: all images, those matched, those with eligible texts but no match, those without any text."""
    tokens = [t for ts in names.values() for t in ts]
    any_token = F.lit(False)
    for t in dict.fromkeys(tokens):
        any_token = any_token | contains_token(F.col("text"), t)
    seen = ocr.groupBy(F.col("image_id").alias("id")).agg(
        F.max(F.coalesce(F.col("confidence") >= least, F.lit(False))).alias("eligible"),
        F.max(F.coalesce((F.col("confidence") >= least) & any_token, F.lit(False))).alias("matched"),
    )
    return images.select("id").join(seen, "id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("matched"), 1)).alias("matched"),
        F.count(F.when(F.col("eligible") & ~F.col("matched"), 1)).alias("no_rule"),
        F.count(F.when(F.col("eligible").isNull(), 1)).alias("no_ocr"),
    )
