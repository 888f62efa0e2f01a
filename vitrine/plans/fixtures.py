"""Catalogue tables made from the test tables, for Spark and, with the same rows, for DuckDB."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors reach: in ``spark.checkpoint.dir``, or a local one that goes with the session's driver."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/catalogue-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@dataclass(frozen=True)
class Catalogue:
    """Lazy views of one data folder."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        d, e = self.table("documents"), self.table("events")
        day = F.date_trunc("day", e.ts).cast("timestamp_ntz")
        name = F.concat(d.source, F.lit("/"), d.doc_id.cast("string"), F.lit(".jpg"))
        return d.join(e, e.event_id == d.doc_id).select(d.doc_id.alias("id"), name.alias("filename"), day.alias("created_at"))

    @cached_property
    def ocr_texts(self) -> DataFrame:
        d = self.table("documents").filter("doc_id % 10 <> 0")
        lines = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        confidence = ((F.col("doc_id") * 31 + F.col("pos") * 17) % 100).cast("double") / 100.0
        return lines.select(
            F.col("doc_id").alias("image_id"), "pos", "text", confidence.alias("confidence"), F.col("lang").alias("language")
        )

    @cached_property
    def tags(self) -> DataFrame:
        d, q = self.table("documents"), self.table("labels")

        def rows(df: DataFrame, key: str, value, source: str) -> DataFrame:
            return df.select(F.col("doc_id").alias("image_id"), F.lit(key).alias("key"), value.alias("value"), F.lit(source).alias("source"))

        return (
            rows(d, "lang", F.col("lang"), "OCR")
            .unionByName(rows(d, "source", F.col("source"), "OCR"))
            .unionByName(rows(d.filter("doc_id % 2 = 0"), "lang", F.col("lang"), "Ollama"))
            .unionByName(rows(q, "quality", F.col("quality").cast("string"), "Ollama"))
        )

    @cached_property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("image_id"), "embedding")

    @cached_property
    def concepts(self) -> DataFrame:
        label = F.col("label")
        return self.table("embeddings").select(
            label.cast("long").alias("id"), F.concat(F.lit("label_"), label.cast("string")).alias("name")
        ).distinct()

    @cached_property
    def concept_image_sets(self) -> DataFrame:
        rows, label, half = self.table("embeddings").filter("vec_id % 5 = 0"), F.col("label").cast("long"), F.col("vec_id") % 2
        return rows.select(
            (label * 2 + half).alias("id"), label.alias("concept_id"), F.concat(F.lit("set_"), half.cast("string")).alias("name")
        ).distinct()

    @cached_property
    def concept_images(self) -> DataFrame:
        return self.table("embeddings").filter("vec_id % 5 = 0").select(
            F.col("vec_id").alias("id"),
            (F.col("label").cast("long") * 2 + F.col("vec_id") % 2).alias("concept_image_set_id"),
            F.concat(F.lit("ref_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("filename"),
            "embedding",
        )

    @cached_property
    def descriptions(self) -> DataFrame:
        return self.table("conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("image_id"), "turn", "text")

    def vector_of(self, image_id: int) -> list[float]:
        from vitrine.sources.tables import one

        return list(one(self.vectors.filter(F.col("image_id") == image_id).select("embedding"))[0])


#: The same views for DuckDB.
DUCKDB_VIEWS = {
    "images": """select d.doc_id as id, concat(d.source, '/', cast(d.doc_id as varchar), '.jpg') as filename,
       cast(cast(e.ts as date) as timestamp) as created_at from documents d join events e on e.event_id = d.doc_id""",
    "ocr_texts": """select doc_id as image_id, pos, string_split(text, chr(10))[pos + 1] as text,
       cast((doc_id * 31 + pos * 17) % 100 as double) / 100.0 as confidence, lang as language
       from (select *, unnest(range(len(string_split(text, chr(10))))) as pos from documents) where doc_id % 10 <> 0""",
    "tags": """select doc_id as image_id, 'lang' as key, lang as value, 'OCR' as source from documents
       union all select doc_id, 'source', source, 'OCR' from documents
       union all select doc_id, 'lang', lang, 'Ollama' from documents where doc_id % 2 = 0
       union all select doc_id, 'quality', cast(quality as varchar), 'Ollama' from labels""",
    "vectors": "select vec_id as id, vec_id as image_id, embedding::double[] as embedding from embeddings",
    "concepts": "select distinct cast(label as bigint) as id, concat('label_', cast(label as varchar)) as name from embeddings",
    "sets": """select distinct cast(label as bigint) * 2 + vec_id % 2 as id, cast(label as bigint) as concept_id,
       concat('set_', cast(vec_id % 2 as varchar)) as name from embeddings where vec_id % 5 = 0""",
    "refs": """select vec_id as id, cast(label as bigint) * 2 + vec_id % 2 as concept_image_set_id,
       concat('ref_', cast(vec_id as varchar), '.jpg') as filename, embedding::double[] as embedding
       from embeddings where vec_id % 5 = 0""",
    "descriptions": "select conv_id as image_id, turn, text from conversations where role = 'assistant'",
}


def over(views: str, query: str) -> str:
    """DuckDB SQL of a query over the named views."""
    return "with " + ",\n".join(f"{v} as ({DUCKDB_VIEWS[v]})" for v in views.split()) + "\n" + query
