"""Sources of a landing folder: exported logs, working trees, pages of an interface, notes."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.scalars import front_matter, pull_number
from corvane.schema import FILE_MAX


def git_log(spark: SparkSession, path: str, authors: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """sha, date, email, parents and message of an exported log whose records end with 0x1e and whose
    fields with 0x1f; merges are left out, and what isn't by one of the authors or from ``since`` on."""
    fields = F.split(F.regexp_replace("value", r"^\s+", ""), "\u001f")
    rows = spark.read.option("lineSep", "\u001e").text(path).filter(F.size(fields) >= 5)
    rows = rows.select(fields[0].alias("sha"), fields[1].alias("date"), F.lower(fields[2]).alias("email"), F.filter(F.split(fields[3], " "), lambda p: p != "").alias("parents"), F.regexp_replace(fields[4], r"\s+$", "").alias("message"))
    rows = rows.filter(F.size("parents") <= 1)
    if authors:
        rows = rows.filter(F.col("email").isin(*(a.lower() for a in authors)))
    return rows if since is None else rows.filter(F.col("date") >= F.lit(since))


def git_show(spark: SparkSession, path: str) -> DataFrame:
    """sha and diff of an export of commits against their first parent, whose records end with 0x1e and
    whose fields with 0x1f. An empty diff stays."""
    fields = F.split(F.regexp_replace("value", r"^\s+", ""), "\u001f", 2)
    rows = spark.read.option("lineSep", "\u001e").text(path).filter(F.size(fields) == 2)
    return rows.select(fields[0].alias("sha"), fields[1].alias("diff"))


def _is_link(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: p.startswith("file:") and os.path.islink(unquote(urlsplit(p).path)))


def working_tree(spark: SparkSession, folder: str, most: int = FILE_MAX) -> DataFrame:
    """path, length and text of files that are UTF-8 and not too large; what is within .git is left
    out, and so are links of a local folder. Sizes are tested before contents are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.filter((F.col("length") <= most) & ~F.col("path").rlike(r"/\.git/")).filter(F.expr("is_valid_utf8(cast(content as string))"))
    rows = rows.filter(~F.pandas_udf(_is_link, "boolean")(F.col("path")))
    return rows.select("path", "length", F.col("content").cast("string").alias("text"))


def pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of pages of an interface, each a JSON array or an object with ``items``."""
    raw = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json(F.get_json_object("value", "$.items"), f"array<{schema}>"), F.from_json("value", f"array<{schema}>"))
    return raw.select(F.explode(items).alias("_item")).select("_item.*")


def comments_by_pull(comments: DataFrame, url: str) -> DataFrame:
    """pull and its comments in order of time."""
    rows = comments.withColumn("pull", pull_number(F.col(url))).filter("pull is not null")
    return rows.groupBy("pull").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "body"))).alias("comments"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of Markdown notes by hand: those that say ``generated: true`` are left out."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(folder, wholetext=True)
    meta = front_matter(F.col("value"))
    made = F.coalesce(F.lower(F.element_at(meta, "generated")) == "true", F.lit(False))
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text")).filter(~made).orderBy("path")


def changed_listings(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """Pages of listings (url, page, etag, ...) that aren't as they were: a listing whose first page has
    the tag that was ``seen`` (url, etag) is left out as a whole. Null tags are never equal."""
    same = pages.filter("page = 1").select("url", "etag").join(seen.select("url", "etag").distinct(), ["url", "etag"], "left_semi")
    return pages.join(same.select("url"), "url", "left_anti")


def seen_tags(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """``seen`` (url, etag) after these pages: the tag of the first page, if it has one."""
    new = pages.filter("page = 1 and etag is not null").groupBy("url").agg(F.max("etag").alias("etag"))
    return seen.select("url", "etag").join(new, "url", "left_anti").unionByName(new)


def write_cache(df: DataFrame, path: str, key: str) -> None:
    """Raw answers as JSON lines, a folder for each value of ``key``; values written anew replace theirs."""
    body = F.to_json(F.struct(*(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    df.select(key, body.alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def read_cache(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """What write_cache wrote: ``key`` and the columns of ``schema``."""
    return spark.read.text(path).select(F.col(key), F.from_json("value", schema).alias("_v")).select(key, "_v.*")
