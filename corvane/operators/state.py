"""Changes to tables as plans over old state and new rows: upserts, deletes, cursors, and an atomic
switch to the new files. Surrogate ids are kept where a key is known and follow the greatest else."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.scalars import strip
from corvane.schema import EMBED_VERSION

#: Columns of a repository that come from its source, and those that say how far it was read.
REPO_FACTS = ("default_branch", "head_sha", "pushed_at", "archived", "visibility", "fork", "size_kb")
REPO_CURSORS = ("last_files_at", "last_commits_at", "last_commits_walked_sha", "last_reviews_at")


def last_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    return df.withColumn("_no", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_no = 1").drop("_no")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_null: bool = False, only: list[str] | None = None, seq: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` by key: new values win, nulls too (with ``keep_null`` a null
    keeps what was there); ``only`` names the columns that new rows may set. Of new rows with one
    key the last by ``seq`` counts. Null keys are equal to each other."""
    columns = [c for c in old.columns if c not in keys]
    may = [c for c in (only or columns) if c in new.columns]
    if seq is not None:
        new = last_of(new, keys, F.desc(seq))
    a = old.select(*keys, F.lit(True).alias("_old"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    b = new.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_new"), *(F.col(c).alias(f"_n_{c}") for c in may))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = a.join(b, on, "full_outer")

    def value(c: str) -> Column:
        if c not in may:
            return F.col(f"_o_{c}")
        fresh = F.coalesce(f"_n_{c}", f"_o_{c}") if keep_null else F.col(f"_n_{c}")
        return F.when(F.col("_new"), fresh).otherwise(F.col(f"_o_{c}"))

    picked = {k: F.when(F.col("_new"), F.col(f"_k_{k}")).otherwise(F.col(k)) for k in keys}
    return both.select(*(picked[c].alias(c) if c in keys else value(c).alias(c) for c in old.columns))


def with_ids(merged: DataFrame, old: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """``merged`` with ids for rows that have none yet, in order of their keys after the greatest id.
    Numbers come from counts of partitions by key, so no task orders all new rows."""
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    fresh = merged.filter(F.col(id_col).isNull()).withColumn("_bin", F.substring(F.sha1(F.concat_ws("\u0001", *keys)), 1, 3))
    bins = fresh.groupBy("_bin").agg(F.count("*").alias("_n"))
    # At most 4096 bins of three digits.
    bins = bins.select("_bin", F.coalesce(F.sum("_n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    fresh = fresh.withColumn("_no", F.row_number().over(W.partitionBy("_bin").orderBy(*keys))).join(bins, "_bin").crossJoin(F.broadcast(top))
    fresh = fresh.withColumn(id_col, (F.col("_top") + F.col("_before") + F.col("_no")).cast(merged.schema[id_col].dataType)).select(*merged.columns)
    return merged.filter(F.col(id_col).isNotNull()).unionByName(fresh)


def upsert_repo(old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts of repositories; cursors are never touched."""
    return upsert(old, new, ["target_id", "full_name"], only=list(REPO_FACTS))


def set_repo_cursor(old: DataFrame, cursors: DataFrame) -> DataFrame:
    """Cursors of known repositories; a null keeps the one there is."""
    known = cursors.join(old.select("target_id", "full_name"), ["target_id", "full_name"], "left_semi")
    return upsert(old, known, ["target_id", "full_name"], keep_null=True, only=list(REPO_CURSORS))


def update_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata of known artifacts; a null keeps the one there is."""
    keys = ["target_id", "kind", "external_id"]
    known = new.join(old.select(*keys), keys, "left_semi")
    return upsert(old, known, keys, keep_null=True)


def upsert_artifacts(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """Artifacts by (target_id, kind, external_id): everything is overwritten but the id."""
    keys = ["target_id", "kind", "external_id"]
    columns = [c for c in old.columns if c not in keys and c != "id"]
    return with_ids(upsert(old, new, keys, only=columns, seq=seq), old, keys)


def split_by_hash(new: DataFrame, old: DataFrame) -> DataFrame:
    """New artifacts with ``action``: unchanged (same hash: metadata only, chunks and vectors stay),
    changed or added. Rows without hash on either side count as changed."""
    keys = ["target_id", "kind", "external_id"]
    known = last_of(old.select(*keys, F.col("content_hash").alias("_hash"), "id"), keys, F.desc("id")).select(*keys, "_hash", F.lit(True).alias("_known"))
    both = new.join(known, keys, "left")
    return both.withColumn("action", F.when(F.col("_known").isNull(), "added").when(F.col("_hash") == F.col("content_hash"), "unchanged").otherwise("changed")).drop("_hash", "_known")


def delete_artifacts(artifacts: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without artifacts (``gone``: id), their chunks and these chunks' vectors."""
    dead = chunks.join(gone.select(F.col("id").alias("artifact_id")), "artifact_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return artifacts.join(gone, "id", "left_anti"), chunks.join(gone.select(F.col("id").alias("artifact_id")), "artifact_id", "left_anti"), vectors.join(dead, "chunk_id", "left_anti")


def delete_target(target_id: int, targets: DataFrame, repos: DataFrame, artifacts: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """All tables without a target and what belongs to it."""
    gone = artifacts.filter(F.col("target_id") == target_id).select("id")
    return targets.filter(F.col("id") != target_id), repos.filter(F.col("target_id") != target_id), *delete_artifacts(artifacts, chunks, vectors, gone)


def write_vectors(vectors: DataFrame, chunks: DataFrame, new: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, chunks): new vectors (chunk_id, embedding) replace old ones, and their chunks get the
    model's name."""
    kept = vectors.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.select("chunk_id", "embedding"))
    done = new.select(F.col("chunk_id").alias("id"), F.lit(model).alias("_model")).distinct()
    return kept, chunks.join(done, "id", "left").withColumn("embed_model", F.coalesce("_model", "embed_model")).select(*chunks.columns)


def write_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with new summaries (id, summary), without white space around them."""
    new = summaries.select("id", strip(F.col("summary")).alias("_new"))
    return chunks.join(new, "id", "left").withColumn("summary", F.coalesce("_new", "summary")).select(*chunks.columns)


def clear_summaries(chunks: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Chunks of some kinds without summary."""
    return chunks.withColumn("summary", F.when(F.col("kind").isin(*kinds), F.lit(None).cast("string")).otherwise(F.col("summary")))


def stale_vectors(stored_version: str | None) -> bool:
    """Whether all vectors must be made anew; no version, or one that is no number, is the first."""
    try:
        return int(stored_version or "1") < EMBED_VERSION
    except ValueError:
        return True


def note_actions(disk: DataFrame, held: DataFrame) -> DataFrame:
    """path and action of notes on disk (path, hash) against those held: unchanged, updated, moved
    (the same content at a path that wasn't known), added, deleted."""
    both = disk.select("path", F.col("hash").alias("_new")).join(held.select("path", F.col("hash").alias("_old")), "path", "full_outer")
    lone = both.filter("_new is null").select(F.col("_old").alias("_new")).distinct().withColumn("_moved", F.lit(True))
    arrived = both.filter("_old is null").select(F.col("_new").alias("_old")).distinct().withColumn("_left", F.lit(True))
    rows = both.join(lone, "_new", "left").join(arrived, "_old", "left")
    action = F.when(F.col("_old") == F.col("_new"), "unchanged").when(F.col("_old").isNotNull() & F.col("_new").isNotNull(), "updated").when(F.col("_old").isNull() & F.col("_moved"), "moved").when(F.col("_old").isNull(), "added").when(F.col("_left"), "moved away").otherwise("deleted")
    return rows.select("path", action.alias("action"))


def page_actions(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """path and action of pages to write (path, text) against those there are (path, text, generated):
    written, unchanged, adopted (kept, since someone edited it by hand), removed."""
    both = expected.select("path", F.col("text").alias("_want")).join(existing.select("path", F.col("text").alias("_have"), "generated"), "path", "full_outer")
    action = F.when(F.col("_have").isNull(), "written").when(F.col("_want").isNull() & F.col("generated"), "removed").when(~F.col("generated"), "adopted").when(F.col("_want") == F.col("_have"), "unchanged").otherwise("written")
    return both.select("path", action.alias("action"))


def upsert_targets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Scopes by (kind, name): external id and addresses are overwritten, and new ones get ids."""
    keys = ["kind", "name"]
    return with_ids(upsert(old, new, keys, only=["external_id", "emails_json"]), old, keys)


def set_sync_cursors(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """Cursors by (target_id, resource); target 0 stands for all. The last write wins; a null cursor
    keeps the one there is."""
    return upsert(old, new, ["target_id", "resource"], keep_null=True, seq=seq)


def upsert_email_logins(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """Logins of addresses, in lower case; the last write wins, a null login is a miss that is kept."""
    return upsert(old, new.withColumn("email", F.lower("email")), ["email"], seq=seq)


def set_cached_profiles(old: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """Cached profiles by key; the last write wins."""
    return upsert(old, new, ["cache_key"], seq=seq)


def first_seen(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of rows with one key the first, as a walk that remembers keys keeps them; null keys are out."""
    return last_of(rows.filter(F.col(key).isNotNull()), [key], *order)


def sync_notes(held: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, actions): notes (id, path, hash, text) after a folder (path, hash, text) was read. Known
    paths get new text, a note whose content stands at a new path moves there under its id, others
    are added or deleted. Of several notes that left with one content the least path moves to the
    least new path, and so on."""
    actions = note_actions(disk.select("path", "hash"), held.select("path", "hash"))
    by = W.partitionBy("hash").orderBy("path")
    left = held.join(actions.filter("action = 'moved away'").select("path"), "path", "left_semi").withColumn("_no", F.row_number().over(by))
    arrived = disk.join(actions.filter("action = 'moved'").select("path"), "path", "left_semi").withColumn("_no", F.row_number().over(by))
    moved = left.select("hash", "_no", "id").join(arrived, ["hash", "_no"]).select("id", "path", "hash", "text")
    stay = disk.join(held.select("id", "path"), "path").select("id", "path", "hash", "text")
    known = stay.unionByName(moved)
    fresh = disk.join(known.select("path"), "path", "left_anti").select(F.lit(None).cast(held.schema["id"].dataType).alias("id"), "path", "hash", "text")
    return with_ids(known.unionByName(fresh), held, ["path"]), actions


#: The file in a table's folder that names its current version.
POINTER = "CURRENT"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version of a table; None if there is none yet."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path}/{spark.read.text(at.toString()).first()[0]}" if fs.exists(at) else None


def switch(spark: SparkSession, df: DataFrame, path: str, keep: int = 1) -> str:
    """Write ``df`` as a new version of the table at ``path`` and point to it. The pointer is one small
    file that a rename replaces, so readers see the old version or the new one, and a crash leaves
    the old; of older versions ``keep`` stay for readers that are still at them. Gives the folder."""
    jvm = spark._jvm
    as_path = jvm.org.apache.hadoop.fs.Path
    old, name = current(spark, path), f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    fs = as_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = as_path(f"{path}/_{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, as_path(f"{path}/{POINTER}"), overwrite)
    versions = sorted((f.getModificationTime(), f.getPath().toString()) for f in fs.listStatus(as_path(path)) if f.getPath().getName().startswith("v-"))
    stay = {name, *(os.path.basename(v) for _, v in versions[-1 - keep :])} | ({os.path.basename(old)} if old else set())
    for _, version in versions:
        if os.path.basename(version) not in stay:
            fs.delete(as_path(version), True)
    return f"{path}/{name}"


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that switch wrote."""
    found = current(spark, path)
    if found is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(found)


def migrate(old: DataFrame, columns: DataFrame) -> DataFrame:
    """``old`` with the columns that ``columns`` has besides, null."""
    return old.unionByName(columns.limit(0), allowMissingColumns=True)
