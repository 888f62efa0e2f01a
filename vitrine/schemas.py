"""Logical tables of the catalogue."""

from __future__ import annotations

#: Spark DDL of each table; vectors are float arrays of any one width.
TABLES = {
    "images": "id STRING, filename STRING, content_hash STRING, width INT, height INT, created_at TIMESTAMP_NTZ",
    "image_metrics": "image_id STRING, read_time_ms DECIMAL(38,18), preprocess_time_ms DECIMAL(38,18), "
    "ocr_time_ms DECIMAL(38,18), total_time_ms DECIMAL(38,18), created_at TIMESTAMP_NTZ",
    "ocr_texts": "id STRING, image_id STRING, text STRING, confidence DOUBLE, bbox ARRAY<ARRAY<DOUBLE>>, language STRING, "
    "created_at TIMESTAMP_NTZ",
    "descriptions": "id STRING, image_id STRING, text STRING, created_at TIMESTAMP_NTZ",
    "embeddings": "id STRING, image_id STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP_NTZ",
    "tags": "id STRING, image_id STRING, key STRING, value STRING, source STRING, created_at TIMESTAMP_NTZ",
    "concepts": "id INT, name STRING, embedding ARRAY<FLOAT>",
    "concept_image_sets": "id INT, concept_id INT, name STRING, directory STRING, centroid_embedding ARRAY<FLOAT>",
    "concept_images": "id INT, concept_image_set_id INT, filename STRING, embedding ARRAY<FLOAT>",
    "concept_text_sets": "id INT, concept_id INT, name STRING, centroid_embedding ARRAY<FLOAT>",
    "concept_texts": "id INT, concept_text_set_id INT, name STRING, text STRING, embedding ARRAY<FLOAT>",
    "processing_errors": "id STRING, image_id STRING, stage STRING, message STRING, created_at TIMESTAMP_NTZ",
    "image_processing_status": "image_id STRING, pipeline STRING, status STRING, started_at TIMESTAMP_NTZ, "
    "finished_at TIMESTAMP_NTZ, error_message STRING",
}
#: Tables whose rows belong to an image and go with it.
IMAGE_CHILDREN = (
    "image_metrics", "ocr_texts", "descriptions", "embeddings", "tags", "processing_errors", "image_processing_status",
)
#: Columns of the nested results.
TAG = "struct<name:string,category:string,score:double,source:string>"
ITEM = f"id string, imageUrl string, originalFileName string, text array<string>, tags array<{TAG}>"
FACET = "name string, buckets array<struct<value:string,count:double>>"
EMBEDDING_DIM = 512
