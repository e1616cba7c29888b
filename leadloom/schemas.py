"""Fixed schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

LEAD = T.StructType([
    T.StructField("url", T.StringType(), False),
    T.StructField("company_name", T.StringType()),
    T.StructField("founder_name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("is_qualified", T.BooleanType(), False),
    T.StructField("drafted_email", T.StringType()),
    T.StructField("retry_count", T.IntegerType(), False),
])

LEAD_STORE = T.StructType([
    T.StructField("email", T.StringType(), False),
    T.StructField("company_name", T.StringType(), False),
    T.StructField("founder_name", T.StringType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("contacted", T.BooleanType(), False),
    T.StructField("delivery_failed", T.BooleanType(), False),
    T.StructField("date_found", T.TimestampType(), False),
])

VISITED = T.StructType([
    T.StructField("url_hash", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("visited_at", T.TimestampType(), False),
])

LINK = T.StructType([
    T.StructField("href", T.StringType()),
    T.StructField("link_text", T.StringType()),
    T.StructField("url", T.StringType()),
])

DECISION = T.StructType([
    T.StructField("decision", T.StringType(), False),
    T.StructField("discovery_summary", T.StringType(), False),
    T.StructField("next_target_urls", T.ArrayType(T.StringType()), False),
    T.StructField("company", T.StringType()),
    T.StructField("person", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("reason", T.StringType()),
])
