"""Ingestion: pluggable model stages with claims, latest status, metrics and errors."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: States of an image in a pipeline; fixed values.
PROCESSING, DONE, FAILED = "processing", "done", "failed"


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; rows of no time come first, and equal times give one row of them."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order)))
    return rows.withColumn("rank", rank).filter("rank = 1").drop("rank")


def latest_status(events: DataFrame) -> DataFrame:
    return latest(events, ["image_id", "pipeline"], "started_at")


def claimable(images: DataFrame, status: DataFrame, pipeline: str) -> DataFrame:
    """Images to process: those of no status or a failed one."""
    busy = status.filter((F.col("pipeline") == pipeline) & F.col("status").isin(PROCESSING, DONE))
    return images.join(busy.select(F.col("image_id").alias("id")), "id", "left_anti")


def claim(images: DataFrame, pipeline: str) -> DataFrame:
    return images.select(
        F.col("id").alias("image_id"), F.lit(pipeline).alias("pipeline"), F.lit(PROCESSING).alias("status"),
        F.current_timestamp().cast("timestamp_ntz").alias("started_at"),
    )


def apply_model(inputs: DataFrame, model: Callable[[bytes], object], result_type: str, pipeline: str) -> DataFrame:
    """(image_id, pipeline, status, result, error_message, total_time_ms) for inputs (id, content).

    The model gets one content and gives a value of ``result_type``; what it raises becomes a failed row.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, content in zip(frame["id"], frame["content"], strict=True):
                began, result, error = time.perf_counter(), None, None
                try:
                    result = model(content)
                except Exception as e:  # noqa: BLE001 - whatever a model raises is recorded
                    error = f"{type(e).__name__}: {e}"
                took = (time.perf_counter() - began) * 1000
                rows.append((i, pipeline, FAILED if error else DONE, result, error, took))
            yield pd.DataFrame(rows, columns=["image_id", "pipeline", "status", "result", "error_message", "total_time_ms"])

    schema = f"image_id string, pipeline string, status string, result {result_type}, error_message string, total_time_ms double"
    return inputs.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(run, schema)


def errors_of(outcomes: DataFrame, stage: str) -> DataFrame:
    return outcomes.filter(F.col("status") == FAILED).select("image_id", F.lit(stage).alias("stage"), F.col("error_message").alias("message"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """One row of metrics an image, the last written; the total is the sum of the parts."""
    total = F.col("read_time_ms") + F.col("preprocess_time_ms") + F.col("ocr_time_ms")
    return latest(metrics, ["image_id"], "created_at").withColumn("total_time_ms", total)


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with those of the new rows' keys replaced."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def outcome_tables(outcomes: DataFrame, stage: str) -> dict[str, DataFrame]:
    """Status, errors and metrics of outcomes; they share one computation, so store the outcomes first."""
    now = F.current_timestamp().cast("timestamp_ntz")
    return {
        "image_processing_status": outcomes.select("image_id", "pipeline", "status", now.alias("finished_at"), "error_message"),
        "processing_errors": errors_of(outcomes, stage),
        "image_metrics": outcomes.select("image_id", "total_time_ms", now.alias("created_at")),
    }


def ingest_folder(images: DataFrame, contents: DataFrame, status: DataFrame, model, result_type: str, pipeline: str) -> DataFrame:
    """Outcomes of the images that no one has claimed: (id, filename) with their (filename, content) from a folder.

    Images without a file get a failed outcome, as does what the model raises on.
    """
    todo = claimable(images.select(F.col("id").cast("string").alias("id"), "filename"), status, pipeline)
    found = todo.join(contents.select("filename", "content"), "filename", "left")

    def read(content):
        if content is None:
            raise FileNotFoundError("no file")
        return model(content)

    return apply_model(found, read, result_type, pipeline)


#: What recognition gives for an image.
RECOGNISED = (
    "struct<width:int,height:int,preprocess_time_ms:double,ocr_time_ms:double,"
    "texts:array<struct<text:string,confidence:double,bbox:array<array<double>>,language:string>>>"
)


def recognise(inputs: DataFrame, decode: Callable, readers: dict[str, Callable], pipeline: str) -> DataFrame:
    """Outcomes, as of ``apply_model``, of recognising text in inputs (id, content).

    ``decode`` gives (picture, width, height) for a content, and each language's reader (box, text, confidence) rows for a
    picture. Every language's texts are kept; a null content is a failure, as is whatever any of them raises.
    """
    def read(content):
        if content is None:
            raise FileNotFoundError("no file")
        began = time.perf_counter()
        picture, width, height = decode(content)
        decoded = time.perf_counter()
        texts = [
            {"text": text, "confidence": float(sure), "bbox": [[float(v) for v in point] for point in box], "language": language}
            for language, reader in readers.items()
            for box, text, sure in reader(picture)
        ]
        took = {"preprocess_time_ms": (decoded - began) * 1000, "ocr_time_ms": (time.perf_counter() - decoded) * 1000}
        return {"width": int(width), "height": int(height), **took, "texts": texts}

    return apply_model(inputs, read, RECOGNISED, pipeline)


def recognised_tables(outcomes: DataFrame, stage: str) -> dict[str, DataFrame]:
    """The tables of ``recognise``'s outcomes: texts, metrics by part of the images done, status and errors.

    Contents come with the scan, which times no single file: the reading time is 0.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    done = outcomes.filter(F.col("status") == DONE)
    texts = done.select(F.expr("uuid()").alias("id"), "image_id", F.inline("result.texts")).withColumn("created_at", now)
    parts = {
        "read_time_ms": F.lit(0.0), "preprocess_time_ms": F.col("result.preprocess_time_ms"),
        "ocr_time_ms": F.col("result.ocr_time_ms"), "total_time_ms": F.col("total_time_ms"),
    }
    metrics = done.select("image_id", *(c.cast("decimal(38,18)").alias(name) for name, c in parts.items()), now.alias("created_at"))
    return outcome_tables(outcomes, stage) | {"ocr_texts": texts, "image_metrics": metrics}


def recognise_folder(spark, folder: str, root: str, decode: Callable, readers: dict[str, Callable], pipeline: str = "ocr") -> DataFrame:
    """Registers a folder's files, claims those without a done or running state, recognises them and adds to the tables
    in ``root``. Gives the run's outcomes.

    Videos are left out. Claims and outcomes are stored before anything is derived from them, so that a task that runs
    again sees the same ones. One run at a time.
    """
    from vitrine.functions.text import is_video
    from vitrine.sources.tables import append, file_bytes, listing, stored

    run = uuid.uuid4().hex
    files = listing(spark, folder, is_video(F.col("filename"))).distinct()
    known = stored(spark, root, "images")
    new = files.join(known.select("filename"), "filename", "left_anti")
    append(new.select(F.expr("uuid()").alias("id"), "filename", F.current_timestamp().cast("timestamp_ntz").alias("created_at")), f"{root}/images")
    here = stored(spark, root, "images").join(files, "filename", "left_semi")
    status = stored(spark, root, "image_processing_status")
    state = status.withColumn("at", F.coalesce("finished_at", "started_at"))
    last = latest(state, ["image_id", "pipeline"], "at")
    claim(claimable(here, last, pipeline), pipeline).write.parquet(f"{root}/claims/{run}")
    claims = spark.read.parquet(f"{root}/claims/{run}")
    append(claims, f"{root}/image_processing_status")
    todo = here.join(claims.select(F.col("image_id").alias("id")), "id", "left_semi")
    recognise(file_bytes(spark, folder, todo), decode, readers, pipeline).write.parquet(f"{root}/outcomes/{run}")
    outcomes = spark.read.parquet(f"{root}/outcomes/{run}")
    for name, rows in recognised_tables(outcomes, pipeline).items():
        append(rows, f"{root}/{name}")
    return outcomes


def embed(inputs: DataFrame, model: Callable[[list[bytes]], object], batch: int = 64) -> DataFrame:
    """(image_id, embedding, error_message) of inputs (id, content): vectors of length 1 of a model that takes batches.

    A batch that the model raises on is taken again one by one, so that only the contents at fault fail; a null content
    and a vector of length 0 fail too.
    """
    def tried(contents: list[bytes]) -> list[tuple]:
        try:
            rows = np.asarray(model(contents), np.float64).reshape(len(contents), -1)
        except Exception as e:  # noqa: BLE001 - whatever a model raises is recorded
            return [(None, f"{type(e).__name__}: {e}")] if len(contents) == 1 else [r for c in contents for r in tried([c])]
        sizes = np.sqrt((rows * rows).sum(axis=1))
        return [((v / s).astype(np.float32), None) if s > 0 else (None, "vector of length 0") for v, s in zip(rows, sizes, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                there = [c for c in part["content"] if c is not None]
                found = iter(tried(there) if there else [])
                rows = [(i, *((None, "no file") if c is None else next(found))) for i, c in zip(part["id"], part["content"], strict=True)]
                yield pd.DataFrame(rows, columns=["image_id", "embedding", "error_message"])

    schema = "image_id string, embedding array<float>, error_message string"
    return inputs.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(run, schema)


def describe(inputs: DataFrame, model: Callable[[bytes], str], pipeline: str = "description") -> dict[str, DataFrame]:
    """``descriptions`` (image_id, text) of what the model answers for, and ``processing_errors`` of the rest.

    The two share one computation: put stored outcomes of ``apply_model`` through ``described_tables`` where the model is dear.
    """
    return described_tables(apply_model(inputs, model, "string", pipeline), pipeline)


def described_tables(outcomes: DataFrame, stage: str) -> dict[str, DataFrame]:
    done = outcomes.filter(F.col("status") == DONE)
    return {"descriptions": done.select("image_id", F.col("result").alias("text")), "processing_errors": errors_of(outcomes, stage)}


def stream_folder(spark, folder: str, model, result_type: str, pipeline: str, out: str, checkpoint: str):
    """A query that puts new files of a folder through the model and appends the outcomes to ``out``.

    Each file is taken once across restarts; files are known by their names.
    """
    from vitrine.functions.text import is_video

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("id"), "content").filter(~is_video(F.col("id")))
    outcomes = apply_model(named, model, result_type, pipeline)
    writer = outcomes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
