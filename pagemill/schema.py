"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

CONTENT_TYPES = ("article", "reference", "product", "profile", "listing", "faq", "other")

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("fetched_at", T.StringType()),
        T.StructField("word_count", T.LongType()),
        T.StructField("char_count", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("text_to_html_ratio", T.DoubleType()),
        T.StructField("links_out_internal", T.ArrayType(T.StringType())),
    ]
)

# Keys a stored document must have, and the values of the others when missing.
REQUIRED_KEYS = ("doc_id", "source", "url", "title", "body_text", "fetched_at", "word_count", "char_count")
