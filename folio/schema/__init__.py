"""Schemas of the data model."""

from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("identifier", T.StringType()),
        T.StructField("annotations", T.MapType(T.StringType(), T.StringType())),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("enriched_content", T.StringType()),
        T.StructField("parent_context", T.StringType()),
        T.StructField("context_level", T.IntegerType()),
    ]
)

DEFINITION = T.StructType([T.StructField(n, T.IntegerType() if n.startswith("line") else T.StringType()) for n in ("type", "name", "line_start", "line_end", "visibility", "signature", "documentation")])
SYMBOL = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("line_start", T.IntegerType()), T.StructField("line_end", T.IntegerType()), T.StructField("is_export", T.BooleanType())])

FILE_METADATA = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("imports", T.ArrayType(T.StringType())),
        T.StructField("definitions", T.ArrayType(DEFINITION)),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
