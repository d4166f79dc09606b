"""Fixed schemas (never inferred)."""

from pyspark.sql import types as T

NEWS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("link", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("refers_to", T.ArrayType(T.StringType())),
])

# Raw records as written by crawlers: timestamp is still an ISO string, no id.
RAW_NEWS = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("refers_to", T.ArrayType(T.StringType())),
])

TAXONOMY = T.StructType([
    T.StructField("Kod", T.StringType()),
    T.StructField("Name", T.StringType()),
    T.StructField("SectionName", T.StringType()),
    T.StructField("Notes", T.StringType()),
])

PROFILE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("chat_id", T.IntegerType()),
    T.StructField("state", T.StringType()),
    T.StructField("last_message_id", T.IntegerType()),
    T.StructField("okveds", T.ArrayType(T.StringType())),
])

ROLE = T.StructType([
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("add_okveds", T.ArrayType(T.StringType())),
])

CITATION_ROW = T.StructType([
    T.StructField("link", T.StringType()),
    T.StructField("suits", T.ArrayType(T.StringType())),
])

MESSAGE = T.StructType([
    T.StructField("channel", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("caption", T.StringType()),
    T.StructField("date", T.TimestampType()),
    T.StructField("entities", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()),
    ]))),
])
