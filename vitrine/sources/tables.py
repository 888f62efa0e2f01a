"""Lookups with a stated number of rows, file listings, refreshing sinks and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vitrine.schemas import IMAGE_CHILDREN, TABLES


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` in a folder, with the columns of its schema; empty where it has not been written."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return empty(spark, name)
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def one(df: DataFrame) -> Row:
    """The only row; an error for none or several. Two rows at most reach the driver."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise LookupError("no row" if not rows else "several rows")
    return rows[0]


def one_or_none(df: DataFrame) -> Row | None:
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise LookupError("several rows")
    return rows[0] if rows else None


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def listing(spark: SparkSession, folder: str, skip: Column | None = None) -> DataFrame:
    """(filename) of the files right in a folder, through Spark's file systems; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    return files if skip is None else files.filter(~skip)


def file_bytes(spark: SparkSession, folder: str, images: DataFrame) -> DataFrame:
    """(id, filename, content) of images whose file is in the folder."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return images.select("id", "filename").join(files, "filename")


def shared_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of two listings and of what they share."""
    both = a.select("filename").distinct().withColumn("a", F.lit(1)).join(
        b.select("filename").distinct().withColumn("b", F.lit(1)), "filename", "full"
    )
    return both.agg(
        F.count("a").alias("size_a"), F.count("b").alias("size_b"), F.count(F.when(F.expr("a = 1 and b = 1"), 1)).alias("size_both")
    )


def missing_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images whose file is not listed."""
    return images.join(files.select("filename"), "filename", "left_anti")


def unregistered(images: DataFrame, children: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the images of ``gone`` (id) and the rows that belong to them."""
    kept = {"images": images.join(gone.select("id"), "id", "left_anti")}
    dead = gone.select(F.col("id").alias("image_id"))
    return kept | {name: df.join(dead, "image_id", "left_anti") for name, df in children.items() if name in IMAGE_CHILDREN}


def replace_all(df: DataFrame, path: str) -> None:
    """Full refresh."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_sources(tags: DataFrame, path: str, sources: list[str]) -> None:
    """Partial refresh: the rows of ``sources`` become those of ``tags``, none where it has none; other sources stay.

    Rows of a source that is not listed are an error: they would stand beside that source's old rows.
    """
    other = tags.filter(F.col("source").isNull() | ~F.col("source").isin(sources)).limit(1).collect()
    if other:
        raise ValueError(f"source {other[0]['source']!r} is not among {sources}")
    tags.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    there = {r["source"] for r in tags.select("source").distinct().collect()}  # at most len(sources) rows
    spark = tags.sparkSession
    for source in sources:
        if source not in there:
            _delete(spark, f"{path.rstrip('/')}/source={_escaped(spark, source)}")


def _escaped(spark: SparkSession, value: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, through Spark's file systems."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(target) and files.getFileStatus(target).isFile()


def report(df: DataFrame, path: str, *order: Column) -> None:
    """A report as one CSV file with a header; reports have a row per concept."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
