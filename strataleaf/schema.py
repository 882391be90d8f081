"""Schemas of the record tables. A tree is a flat table of nodes in preorder (``pos``)."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

PAGES = StructType([StructField("physical_start", IntegerType()), StructField("physical_end", IntegerType()), StructField("logical_start", StringType()), StructField("logical_end", StringType())])

IMAGE = StructType([StructField(n, IntegerType() if n == "page" else StringType()) for n in ("image_id", "label", "caption", "path", "page", "image_type")])

TABLE = StructType(
    [
        StructField("table_id", StringType()),
        StructField("caption", StringType()),
        StructField("page", IntegerType()),
        StructField("headers", ArrayType(StringType())),
        StructField("rows", ArrayType(ArrayType(StringType()))),
        StructField("markdown", StringType()),
        StructField("image_path", StringType()),
    ]
)

DOCUMENT = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("source_file", StringType()),
        StructField("source_format", StringType()),
        StructField("total_pages", IntegerType()),
        StructField("extracted_at", TimestampType()),
        StructField("extraction_path", StringType()),
    ]
)

NODE = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("pos", IntegerType()),
        StructField("parent_pos", IntegerType()),
        StructField("level", IntegerType()),
        StructField("id", StringType()),
        StructField("section_id", StringType()),
        StructField("depth", IntegerType()),
        StructField("node_type", StringType()),
        StructField("title", StringType()),
        StructField("text", StringType()),
        StructField("pages", PAGES),
        StructField("confidence", DoubleType()),
        StructField("images", ArrayType(IMAGE)),
        StructField("tables", ArrayType(TABLE)),
        StructField("is_phantom", BooleanType()),
    ]
)

SPAN = StructType(
    [StructField("doc_id", LongType()), StructField("line_no", IntegerType()), StructField("page", IntegerType()), StructField("block_index", IntegerType()), StructField("text", StringType())]
    + [StructField(n, DoubleType()) for n in ("font_size", "x0", "y0", "x1", "y1", "line_height")]
    + [StructField("is_bold", BooleanType())]
)

NODE_TYPES = ("root", "parent", "child")
EXTRACTION_PATHS = ("fast", "slow", "mixed", "vlm")
