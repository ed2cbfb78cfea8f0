"""Tables and nested records of the document store."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.IntegerType())),
    T.StructField("type", T.StringType()),
    T.StructField("rotation", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("primary_confidence", T.DoubleType()),
    T.StructField("secondary_confidence", T.DoubleType()),
])

CELL = T.StructType([
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("row_span", T.IntegerType()),
    T.StructField("col_span", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

TABLE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("bbox", T.ArrayType(T.IntegerType())),
    T.StructField("csv_path", T.StringType()),
    T.StructField("json_path", T.StringType()),
    T.StructField("structure", T.StructType([T.StructField("cells", T.ArrayType(CELL))])),
])

DATE_FIELD = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("raw", T.StringType()),
    T.StructField("format", T.StringType()),
])
TOTAL_FIELD = T.StructType([
    T.StructField("value", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("raw", T.StringType()),
    T.StructField("currency", T.StringType()),
])
VENDOR_FIELD = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("raw", T.StringType()),
])
FIELDS = T.StructType([
    T.StructField("date", DATE_FIELD),
    T.StructField("total", TOTAL_FIELD),
    T.StructField("vendor", VENDOR_FIELD),
])
STRUCTURED = T.StructType([
    T.StructField("fields", FIELDS),
    T.StructField("anomalies", T.ArrayType(T.StringType())),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("md5_hash", T.StringType()),
    T.StructField("datetime", T.TimestampType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("workflow_state", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("folder_id", T.LongType()),
])

TEXTS = T.StructType([
    T.StructField("id_doc", T.LongType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("markdown_text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("blocks", T.ArrayType(BLOCK)),
    T.StructField("tables", T.ArrayType(TABLE)),
    T.StructField("structured_data", STRUCTURED),
])

VERSIONS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("version_number", T.LongType(), False),
    T.StructField("text_content", T.StringType()),
    T.StructField("markdown_content", T.StringType()),
    T.StructField("structured_data", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("created_by", T.StringType()),
    T.StructField("change_reason", T.StringType()),
])
