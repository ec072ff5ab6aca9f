"""Reports: tables for a console as lines of text, and spans of work as lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def console_table(df: DataFrame, *order: Column) -> DataFrame:
    """line_no and line of a report of few rows: a head, a rule and the rows in order, columns as wide
    as their widest value, numbers to the right. Nulls are a hyphen."""
    right = {f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")}
    said = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in df.columns), F.row_number().over(W.orderBy(*order)).alias("_no"))
    # One row of widths.
    widths = said.agg(*(F.greatest(F.coalesce(F.max(F.char_length(c)), F.lit(0)), F.lit(len(c))).alias(f"_w_{c}") for c in df.columns))
    cell = lambda c, x: F.lpad(x, F.col(f"_w_{c}"), F.lit(" ")) if c in right else F.rpad(x, F.col(f"_w_{c}"), F.lit(" "))
    line = lambda of: F.rtrim(F.concat_ws("  ", *(cell(c, of(c)) for c in df.columns)))
    rows = said.crossJoin(F.broadcast(widths)).select((F.col("_no") + 2).cast("long").alias("line_no"), line(F.col).alias("line"))
    head = widths.select(F.lit(1).cast("long").alias("line_no"), line(F.lit).alias("line"))
    rule = widths.select(F.lit(2).cast("long").alias("line_no"), F.concat_ws("  ", *(F.repeat(F.lit("-"), F.col(f"_w_{c}")) for c in df.columns)).alias("line"))
    return head.unionByName(rule).unionByName(rows)


def spans(steps: DataFrame, service: str) -> DataFrame:
    """One JSON line a trace in the form that collectors of OpenTelemetry take, from steps (trace,
    step, parent, name, began, ended, and ``attributes``, a map of texts). Ids are hashes of trace and
    step; times are nanoseconds as text."""
    span_id = lambda *c: F.substring(F.sha1(F.concat_ws("/", *c)), 1, 16)
    nanos = lambda c: (F.unix_micros(c) * 1000).cast("string")
    value = lambda v: F.struct(v.alias("stringValue"))
    attributes = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value")))
    trace = F.substring(F.sha2(F.col("trace").cast("string"), 256), 1, 32)
    span = F.struct(nanos(F.col("began")).alias("startTimeUnixNano"), span_id("trace", "step").alias("spanId"), trace.alias("traceId"), F.when(F.col("parent").isNotNull(), span_id("trace", "parent")).alias("parentSpanId"), F.col("name").alias("name"), nanos(F.col("ended")).alias("endTimeUnixNano"), attributes.alias("attributes"))
    held = steps.groupBy("trace").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), value(F.lit(service)).alias("value"))).alias("attributes"))
    return held.select("trace", F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("line"))
