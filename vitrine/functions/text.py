"""Text columns: matching, formatting and small conversions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of content types; fixed values.
EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}


def matches_anywhere(text: Column, query: str) -> Column:
    """Case-blind search with the query's ``%`` and ``_`` as wildcards; a backslash makes the next of them literal.

    A backslash before anything else is dropped, as it is where the escape character precedes an ordinary character.
    """
    tidy = re.sub(r"\\(?![%_\\])", "", query.upper())
    if (len(tidy) - len(tidy.rstrip("\\"))) % 2:
        tidy = tidy[:-1]
    return F.upper(text).like(f"%{tidy}%")


def contains_token(text: Column, token: str) -> Column:
    """Case-blind substring test."""
    return F.contains(F.lower(text), F.lit(token.lower()))


def holds_word(text: Column, token: str) -> Column:
    """Case-blind whole-word test; letters of all scripts make up words."""
    return F.rlike(text, F.lit(rf"(?iuU)\b\Q{token}\E\b"))


def with_confidence(text: Column, confidence: Column) -> Column:
    return F.concat(text, F.lit(" ("), confidence.cast("string"), F.lit(")"))


def image_url(image_id: Column) -> Column:
    return F.concat(F.lit("/api/images/"), image_id.cast("string"))


def slug(query: Column) -> Column:
    return F.replace(F.lower(query), F.lit(" "), F.lit("-"))


def extension(content_type: Column) -> Column:
    """The extension of a content type without its parameters, in any case; ``.bin`` for others and for null."""
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return F.coalesce(kinds[kind], F.lit(".bin"))


def bounded_side(side: Column, other: Column, longest: int = 1600) -> Column:
    """A side scaled so that the longer one is ``longest`` at most, cut to a whole number."""
    top = F.greatest(side, other)
    return F.when(top > longest, (side * (F.lit(float(longest)) / top)).cast("int")).otherwise(side)


def polygon(box: Column) -> Column:
    """Points of a box written in JSON."""
    return F.from_json(box, "array<array<double>>")


def is_video(name: Column) -> Column:
    return F.endswith(F.lower(name), F.lit(".mp4"))


#: What a structured description may hold.
DESCRIPTION = "description string, template string, emotions array<string>, concepts array<string>, tags array<string>"


def structured_description(answer: Column) -> Column:
    """The JSON object in a model's answer, text around it left out; null where there is none."""
    return F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), DESCRIPTION)
