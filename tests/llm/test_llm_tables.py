import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import generated, history, mix


def _files(spark):
    hand = "import x\n\n# Adds two numbers that are given.\ndef add(first, second):\n    total = first + second\n    return total\n"
    packed = "!function(a){var b=a||{};for(var c=0;c<9;c++)b[c]=c;b.x=!0}(this);" * 30
    rng = random.Random(5)
    like = lambda: hand.replace("total", f"total{rng.randint(0, 99)}")
    files, chunks = [], []

    def put(k, path, text, repo="me/app", language="python", ctx=None):
        files.append((k, f"https://h.example/{repo}/blob/abc/{path}" if path else None, repo, language))
        for piece in text if isinstance(text, list) else [text]:
            chunks.append((k, piece, ctx or f'{{"repo":"{repo}","path":"{path}"}}'))

    for k in range(60):
        put(k, f"src/f{k}.py", hand.replace("total", f"total{rng.randint(0, 99)}") * rng.randint(1, 4))
    for k in range(60, 80):
        put(k, f"web/a{k}.min.js" if k < 75 else f"web/a{k}.js", packed[: rng.randint(600, 1900)], language="javascript")
    put(100, "src/g.py", "# Code generated by tool. DO NOT EDIT.\n" + like())
    put(101, "third_party/x/y.py", like())
    put(102, "src/h.py", '# Writes the "do not edit" banner for files that the tool generates.\n' + like())
    put(103, "src/vendors/vendor_list.py", like())
    put(104, "src/i.py", like(), ctx='{"repo":"other/lib","path":"src/i.py"}')
    put(105, "conf/x.yaml", "# generated by tool\na: 1\n", language="yaml")
    put(106, None, [None, ""], ctx="{cut")
    put(107, "src/data.py", "ROWS = [\n" + "".join(f"    [{k}, 1.5, \"x\"],\n" for k in range(40)) + "]\n")
    for k in range(12):  # the forest decides, so each kind must occur more than once
        put(200 + k, f"third_party/x/y{k}.py", like())
        put(220 + k, f"src/i{k}.py", like(), ctx=f'{{"repo":"other/lib","path":"src/i{k}.py"}}')
        put(240 + k, f"src/data{k}.py", "ROWS = [\n" + "".join(f"    [{j}, {k}.5, \"x\"],\n" for j in range(40)) + "]\n")
        put(260 + k, f"src/u{k}.py", like())
        files[-1] = (260 + k, f"https://git@h.example/far/lib/blob/abc/src/u{k}.py", "me/app", "python")
    files.append((108, None, None, None))
    return spark.createDataFrame([(*f, 1) for f in files], "id long, source_url string, repo string, language string, score int"), spark.createDataFrame(chunks, "artifact_id long, text string, context_json string")


def test_written_by_hand_or_not(spark):
    files, chunks = _files(spark)
    rows = {r.id: r for r in generated.judge(generated.features(files.drop("score"), chunks)).collect()}
    assert len(rows) == files.count()
    assert {k for k, r in rows.items() if r.found} == {*range(60, 80), 100, 101, 104, 107, *(k + j for k in (200, 220, 240, 260) for j in range(12))}
    assert all(rows[k].score > 0.5 and not rows[k].notice for k in range(75, 80))
    assert all(rows[k].score > 0.5 for k in range(60, 75)) and rows[100].header and not rows[101].header
    assert generated.judge(generated.features(files.limit(0), chunks.limit(0))).count() == 0


def test_paths_and_heads():
    licence = "".join(f"// Line {k} of a licence that is long enough to hide what follows it in any file.\n" for k in range(30))
    assert generated.header_notice(licence + "//\n// Code generated by x. DO NOT EDIT.\npackage a\n")
    assert generated.header_notice("/*\n" + "words of a licence\n" * 40 + "Vendored copy of a/b\n*/\nint x;\n")
    assert generated.header_notice("int x;\n" * 50 + "// Copied unchanged from a/b\n\n") and not generated.header_notice("int x;\n// Copied unchanged from a/b\nint y;\n")
    assert not generated.header_notice('# Puts the "do not edit" banner in front.\nx = 1\n') and not generated.header_notice("")
    assert generated.path_of("https://h/r/blob/ab/a\\b.py?x=1", None) == "a/b.py" and generated.path_of(None, "c") == "c" and generated.path_of(None, None) == ""
    assert [generated.path_notice(p) for p in ("a/__generated__/x.go", "lib/x_1a.pb.go", "web/y_2b-min.js", "src/generator/z.py", "lib/distance/a.py", "m_3c_pb2.py", "")] == [True, True, True, False, False, True, False]


def _records():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    texts = [[rng.choice(words) for _ in range(rng.randint(10, 90))] for _ in range(60)]
    old = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, None), (901, "")]
    new = []
    for k in range(80):
        t = list(rng.choice(texts))
        kind = k % 4
        if kind == 1:
            for _ in range(max(1, len(t) // 12)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind == 2:
            t = [rng.choice(words) for _ in range(40)]
        elif kind == 3 and len(t) > 6:
            del t[rng.randrange(len(t))]
        new.append((1000 + k, k, " ".join(t).upper() if kind == 0 else ", ".join(t)))
    new += [(2000, 500, None), (2001, 501, ""), (2002, 502, new[2][2]), (2003, 502, "one two")]
    return old, new


def test_repeats_are_those_of_brute_force(spark):
    old, new = _records()
    o = spark.createDataFrame(old, "id long, text string")
    n = spark.createDataFrame([(*r, 0) for r in new], "arrival_id long, seq long, text string, own int")
    want = set()
    for k, s, t in new:
        x = history.words(t)
        for k2, s2, t2 in [(a, -1, b) for a, b in old] + new:
            y = history.words(t2)
            if s2 < s and min(len(x), len(y)) >= 15 and history.in_order(x, y) >= 0.8 * max(len(x), len(y)):
                want.add(k)
    for order in (None, history.order_of(o.select("text")), np.full(history.COUNTERS, 1 << 16, np.int32)):
        store = history.History(spark, buckets=4, order=order)
        store.load(o, "id", "text")
        assert {r.own for r in store.accept(n, "arrival_id", "seq", "text", o, "id", "text").collect()} == want
        store.drop()


def test_repeats_by_fragments_that_many_texts_share(spark):
    rng = random.Random(11)
    old, new = [], []
    for k in range(12):
        base = [f"a{k}x{i}" for i in range(60)]
        cut = [base[i : i + 4] for i in range(0, 60, 5)]
        old.append((k, " ".join(base)))
        new.append((1000 + k, k, " ".join(w if i % 5 < 4 else f"new{k}x{i}" for i, w in enumerate(base))))
        for j in range(4):  # the fragments in other orders, which repeats nothing
            rng.shuffle(cut)
            old.append((100 + 10 * k + j, " ".join(f"{' '.join(c)} o{k}x{j}x{i}" for i, c in enumerate(cut))))
    o = spark.createDataFrame(old, "id long, text string")
    n = spark.createDataFrame(new, "arrival_id long, seq long, text string")
    store = history.History(spark, buckets=4)
    store.load(o, "id", "text")
    assert {r.own for r in store.accept(n, "arrival_id", "seq", "text", o, "id", "text").collect()} == {1000 + k for k in range(12)}
    store.drop()


def _changed(rng, base, k, even):
    """A fifth of the words replaced, at random places or evenly spread."""
    n, out = len(base), list(base)
    many = n - history.least_common(n)
    for i, at in enumerate([i * n // max(1, many) for i in range(many)] if even else rng.sample(range(n), many)):
        out[at] = f"z{k}x{i}"
    return out


def test_no_pair_at_the_least_share_is_lost(spark):
    """Words are few, so that rare ones are in many texts."""
    rng = random.Random(21)
    old, new = [], []
    for k in range(300):
        base = [f"w{int(rng.random() ** 2 * 90)}" for _ in range(rng.choice((15, 16, 20, 30, 60, 200)))]
        old.append((k, " ".join(base)))
        new.append((1000 + k, k, " ".join(_changed(rng, base, k, k % 2))))
    o = spark.createDataFrame(old, "id long, text string")
    n = spark.createDataFrame(new, "arrival_id long, seq long, text string")
    store = history.History(spark, buckets=4, order=history.order_of(o.select("text")))
    store.load(o, "id", "text")
    assert store.accept(n, "arrival_id", "seq", "text", o, "id", "text").count() == 300
    store.drop()


def test_batches_are_checked_one_after_the_other(spark):
    old, new = _records()
    rows = [(a, 1 + j // 30, "pr", f"e{j % 50}", None if j % 7 else "h", t) for j, (a, _, t) in enumerate(new)]
    o = spark.createDataFrame(old, "id long, text string")
    n = spark.createDataFrame(rows, "arrival_id long, batch_no int, kind string, external_id string, content_hash string, text string")
    records = spark.createDataFrame([("pr", "e7", "h"), ("pr", "e8", None)], "kind string, external_id string, content_hash string")
    got = []
    for whole in (True, False):
        store = history.History(spark, buckets=4, keys=("kind", "external_id", "content_hash"))
        store.load(o, "id", "text", records)
        found = []
        for no in [None] if whole else sorted({r[1] for r in rows}):
            batch, earlier = (n, None) if whole else (n.filter(F.col("batch_no") == no), n.filter(F.col("batch_no") < no))
            found += [r.own for r in store.accept(batch, "arrival_id", "arrival_id", "text", o, "id", "text", earlier).collect()]
        got.append(sorted(found))
        store.drop()
    assert got[0] == got[1] and 1007 in got[0]


def test_the_history_is_not_shuffled(spark):
    old, new = _records()
    o, n = spark.createDataFrame(old, "id long, text string"), spark.createDataFrame(new, "arrival_id long, seq long, text string")
    store = history.History(spark, buckets=4)
    store.load(o, "id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = history._asked(history.fingerprints(n, "arrival_id", "text", "seq"))
        plan = history.meet(asked, store.held("words"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Below the join's side of the history there is an aggregation by key and the scan, and no exchange.
    scan = plan.index(f"{store.name}_words".lower()) if f"{store.name}_words".lower() in plan.lower() else plan.index("Bucketed: true")
    side = plan[plan.index("SortMergeJoin") if "SortMergeJoin" in plan else 0 : scan]
    assert "Bucketed: true" in plan and "Exchange" not in side[side.rindex("ObjectHashAggregate") :] and plan.count("Exchange hashpartitioning(hash") <= 2
    store.drop()


def test_words_in_order():
    rng = random.Random(8)

    def slow(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            last = 0
            for j, b in enumerate(y):
                row[j + 1], last = (last + 1 if a == b else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    for _ in range(200):
        x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert history.in_order(x, y) == slow(x, y)
    assert history.words("A_b-ç9") == ["a", "b", "ç9"] and history.words(None) == []


def test_repeats_by_key(spark):
    old = spark.createDataFrame([("pr", "a", "h"), ("pr", "b", None)], "kind string, external_id string, content_hash string")
    new = spark.createDataFrame([(1, "pr", "a", "h"), (2, "pr", "b", None), (3, "pr", "c", "x"), (4, "pr", "c", "x"), (5, None, "c", "x"), (6, "pr", "a", "other")], "arrival_id long, kind string, external_id string, content_hash string")
    store = history.History(spark, buckets=2, keys=("kind", "external_id", "content_hash"))
    assert {r.own for r in store.known_keys(new, "arrival_id", "arrival_id").collect()} == {4}
    store._add_keys(old.dropna())
    assert {r.own for r in store.known_keys(new, "arrival_id", "arrival_id").collect()} == {1, 4}
    store.drop()


def test_mix_meets_its_shares(spark):
    rng = random.Random(9)
    words = {s: [f"{s}{k}" for k in range(60)] for s in ("file", "note", "pr")}
    docs = []
    for k in range(900):
        s = rng.choice(["file"] * 6 + ["note"] * 2 + ["pr"])
        docs.append((k, " ".join(rng.choice(words[s]) for _ in range(rng.randint(5, 40))), rng.choice([s, s.upper(), f" {s}\n"])))
    docs += [(2000 + k, " ".join(rng.choice(words["note"]) for _ in range(20)), None if k % 2 else "other") for k in range(40)] + [(3000, None, "file"), (3001, "", "pr"), (3002, "  ", "note")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    shares = spark.createDataFrame([("file", 0.5, 1), ("note", 0.3, 3), ("pr", 0.1, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    taken, report = mix.mix(d, shares.filter("source <> 'absent'"))
    rows = {r.source: r for r in report.collect()}
    goal = {"file": 0.5 / 0.9, "note": 0.3 / 0.9, "pr": 0.1 / 0.9}
    assert all(abs(rows[s].actual_share - g) < 0.004 for s, g in goal.items())
    copies = taken.collect()
    assert all(1 <= r.copies <= {"file": 1, "note": 3, "pr": 4}[r.source] for r in copies) and not {r.doc_id for r in copies} & {3000, 3001, *range(2000, 2040)}
    assert all(r.steps > 0 and 0 <= r.least_rate <= r.most_rate <= r.max_repeats for r in rows.values())
    assert sum(r.expected_share for r in rows.values()) == pytest.approx(1, abs=1e-4)
    assert {r.source: r.actual_share for r in mix.mix(d, shares)[1].collect()}["absent"] == 0
    soft = mix.mix(d, shares.filter("source <> 'absent'"), soft=True)[0].filter("source is null")
    assert soft.count() > 0 and soft.agg(F.max("copies")).first()[0] <= 3
    empty, none = mix.mix(d.limit(0), shares)
    assert empty.count() == 0 and none.count() == 4


def test_rates_are_those_of_documents(spark):
    """Notes that read like files get another rate than plain notes, and sources still meet their targets."""
    rng = random.Random(3)
    words = {s: [f"{s}{k}" for k in range(30)] for s in ("file", "note")}
    docs = [(k, " ".join(rng.choices(words["file" if k % 4 < 2 or k % 16 == 3 else "note"], k=30)), "file" if k % 4 < 2 else "note") for k in range(1600)]
    shares = spark.createDataFrame([("file", 0.4, 2), ("note", 0.6, 3)], "source string, target_share double, max_repeats int")
    taken, report = mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), shares)
    rows = {r.source: r for r in report.collect()}
    assert abs(rows["file"].actual_share - 0.4) < 0.005 and abs(rows["note"].actual_share - 0.6) < 0.005
    assert rows["note"].most_rate > rows["note"].least_rate and rows["note"].steps > 1
    hard = {r.source: r.n for r in taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    assert hard["file"] / sum(hard.values()) == pytest.approx(rows["file"].actual_share, abs=1e-4)


def test_soft_shares_hold_all_tokens(spark):
    docs = [(k, f"{s} {s}x {s}y word{k}", s) for k in range(60) for s in [("file", "note")[k % 2]]] + [(100 + k, "note notex notey", None) for k in range(20)]
    shares = spark.createDataFrame([("file", 0.5, 1), ("note", 0.5, 2)], "source string, target_share double, max_repeats int")
    taken, report = mix.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), shares, soft=True)
    assert taken.filter("source is null").count() > 0
    rows = report.collect()
    assert sum(r.actual_share for r in rows) == pytest.approx(1, abs=1e-5)
    assert abs(sum(r.mix_tokens for r in rows) - taken.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]) <= 1


def test_posteriors_tell_domains(spark):
    rows = [(k, "alpha beta gamma" if k % 2 else "delta eps zeta", ["a", "b"][k % 2]) for k in range(60)] + [(100, "beta alpha", None), (101, "zeta", None), (102, None, None)]
    p = {r.doc_id: r.p for r in mix.memberships(spark.createDataFrame(rows, "doc_id long, text string, domain string"), ["a", "b"]).collect()}
    assert p[100][1] > 0.9 and p[101][0] > 0.9 and sum(p[102]) == pytest.approx(1)


def test_the_order_counts_every_text(spark):
    texts = spark.createDataFrame([(f"alpha beta alpha w{k}",) for k in range(40)] + [(None,), ("",)], "text string")
    counts = history.order_of(texts, texts.limit(0))
    place = lambda w: history.tokens(w.split())[-1] % history.COUNTERS
    assert counts.sum() == 160 and [counts[place(w)] >= 40 for w in ("alpha", "alpha alpha", "beta")] == [True] * 3
    row = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "id long, text string")
    slots = lambda n: {w.k for w in history.fingerprints(row, "id", "text", order=np.full(history.COUNTERS, n)).first().words}
    assert slots(history.SLOT - 1) == {1} and slots(8 * history.SLOT) == {9}


def test_pairs_and_batches_of_groups_are_bounded(spark):
    signs = history.signature(history.tokens([f"w{k}" for k in range(20)]))
    row = lambda own, seq: {"own": own, "seq": seq, "n": 20, **dict(zip(history._SIGNATURE, signs)), "whole": False}
    kind = pa.list_(pa.struct([*((c, pa.int64()) for c in ("own", "seq", "n", *history._SIGNATURE)), ("whole", pa.bool_())]))
    held, asked = [row(k, k) for k in range(700)], [row(k, k) for k in range(1000, 1700)]
    batch = pa.RecordBatch.from_arrays([pa.array([asked, asked], kind), pa.array([held, held], kind)], names=["_asked", "_rows"])
    out = [b.num_rows for b in history._told(iter([batch]))]
    assert sum(out) == 2 * 700 * 700 and max(out) <= 2 * history.CELLS
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    history.fingerprints(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
