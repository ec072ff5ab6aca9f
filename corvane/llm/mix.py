"""Problem 9: mixing sources to target weights.

A classifier is trained on a bounded, stratified sample of the documents of listed sources and gives
every document its posteriors of the domains. A document also belongs to its own source as a whole.
Nonnegative rates of documents are fitted by projected gradient on two sums of squares at once: the
distance of the sources' token totals from their targets, and that of the expected totals of the
domains (tokens by posteriors). The gradient at a document is a sum over its memberships, so a rate
is the clipped sum of its memberships times one multiplier each, and a step is one aggregation that
sends two numbers a domain to the driver; equal memberships are put together before. Rates become
copies by a hash of the document's id, with one threshold for each source, found from histograms of
the hash, that brings the source's total to its target.

Sources are compared in lower case without surrounding blanks. By default documents of sources that
aren't listed stay out of the mix (rate 0), since shares are those of sources; ``soft`` takes them
in by their posteriors. Defined results: null, empty and blank texts have no tokens and no copies;
a listed source without documents has an actual share of 0."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import count_tokens
from corvane.runtime import durable

#: Labelled documents to train on at most, hashed words, steps, where a fit is good enough, and the
#: share of what is left by which a step must better it.
SAMPLE, WORDS, STEPS, CLOSE, FLAT = 20_000, 1 << 14, 24, 1e-4, 1e-2
#: Steps of a posterior, so that equal ones can be put together, and the weight of expected totals.
GRID, SOFTLY = 20, 1.0
#: Bins of a histogram of hashes (two levels of them), and places of the hash that draws the sample.
BINS, PLACES = 4096, 1 << 53


def source_name(column: Column) -> Column:
    """A source without case and surrounding blanks."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def memberships(docs: DataFrame, names: list[str], sample: int = SAMPLE) -> DataFrame:
    """doc_id and ``p``, the posteriors of the domains ``names`` on a grid of GRID steps, of all
    documents. ``docs``: doc_id, text, domain (null where the source isn't listed). Each domain gives
    at most its part of the sample, so a rare one is in it as a whole."""
    labelled = docs.filter("domain is not null and text is not null")
    counts = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return docs.select("doc_id", F.array_repeat(F.lit(1.0 / max(1, len(names))), len(names)).alias("p"))
    limit = F.coalesce(*(F.when(F.col("domain") == s, F.lit(int(PLACES * min(1.0, sample / len(counts) / n)))) for s, n in counts.items()))
    drawn = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)) < limit)
    index = F.array_position(F.array(*map(F.lit, names)), F.col("domain")) - 1
    drawn = durable(drawn.select("text", index.cast("double").alias("label")), "drawn")
    stages = [RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=WORDS, binary=True), NaiveBayes(featuresCol="_tf", labelCol="label", smoothing=0.5)]
    model = Pipeline(stages=stages).fit(drawn)
    scored = model.transform(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", vector_to_array("probability").alias("p"))
    # The model has columns up to the last class of the sample. A class that the sample doesn't hold has
    # no say, and what the grid loses goes to the likeliest.
    held = F.array(*(F.lit(s in counts) for s in names))
    full = F.slice(F.concat("p", F.array_repeat(F.lit(0.0), len(names))), 1, len(names))
    steps = F.transform(F.zip_with(full, held, lambda x, h: F.when(h, x).otherwise(0.0)), lambda x: F.floor(x * GRID) / GRID)
    scored = scored.withColumn("_s", steps).withColumn("_best", F.array_position("_s", F.array_max("_s")))
    left = 1.0 - F.aggregate("_s", F.lit(0.0), lambda t, x: t + x)
    return scored.select("doc_id", F.transform("_s", lambda x, i: F.round(F.when(i + 1 == F.col("_best"), x + left).otherwise(x), 4)).alias("p"))


def _dot(column: str, xs: list[float]) -> Column:
    return F.aggregate(F.zip_with(column, F.array(*(F.lit(float(x)) for x in xs)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def rate_of(m: list[float], u: list[float], caps: list[float]) -> Column:
    """The rate of a document: memberships ``q`` (its source) and ``p`` (its posteriors) times their
    multipliers, between 0 and the most that its source allows."""
    return F.least(F.greatest(_dot("q", m) + _dot("p", u), F.lit(0.0)), _dot("q", caps))


def fit(rows: DataFrame, goals: list[float], caps: list[float], steps: int = STEPS) -> tuple[list[float], list[float], int]:
    """(multipliers of sources, multipliers of domains, steps taken), so that totals of the sources and
    expected totals of the domains come close to ``goals``. ``rows``: n (tokens), q and p, equal
    memberships put together."""
    k = range(len(goals))
    both = [F.sum(F.col("n") * F.col("r") * F.col(c)[i]) for c in ("q", "p") for i in k]
    sizes = [float(x or 0.0) for x in rows.withColumn("r", F.lit(1.0)).agg(*both).first()]
    m, u = [min(c, g / s) if s else 0.0 for g, s, c in zip(goals, sizes, caps)], [0.0 for _ in k]
    taken, pace, before = 0, 1.0 / (1.0 + SOFTLY), float("inf")
    last = m + u
    for taken in range(1, steps + 1):
        # Accelerated: the gradient is taken a little further along the last move.
        ahead = [x + (taken - 1) / (taken + 2) * (x - y) for x, y in zip(m + u, last)]
        rates = rate_of(ahead[: len(m)], ahead[len(m) :], caps)
        totals = [float(x or 0.0) for x in rows.withColumn("r", rates).agg(*both).first()]
        gap = [(t - g) / s if s else 0.0 for t, g, s in zip(totals, [*goals, *goals], sizes)]
        loss = sum(s * d * d for s, d in zip(sizes, gap))
        if max(map(abs, gap), default=0.0) < CLOSE or loss > (1 - FLAT) * before:
            break
        before, last = loss, m + u
        # A source at the most it may give moves no further.
        m = [min(max(x - pace * d, -c), 2 * c) for x, d, c in zip(ahead, gap, caps)]
        u = [x - pace * SOFTLY * d for x, d in zip(ahead[len(m) :], gap[len(m) :])]
    return m, u, taken


def _threshold(docs: DataFrame, groups: list[tuple[str, float]]) -> dict[str, float]:
    """For each domain the place (``_h``, 0 to BINS squared) below which its documents hold as many
    tokens as asked. ``docs``: domain, n, _h."""
    base = docs.select("domain", "n", "_h")
    first = base.groupBy("domain", F.floor(F.col("_h") / BINS).alias("_b")).agg(F.sum("n").alias("n")).collect()
    out, picked, before = {}, {}, {}
    for name, want in groups:
        total = 0.0
        out[name] = BINS * BINS if want > 0 else 0
        for b, n in sorted((r["_b"], r["n"]) for r in first if r["domain"] == name):
            if total + n > want:
                picked[name], before[name] = b, total
                break
            total += n
    if not picked:
        return out
    cases = F.coalesce(*(F.when((F.col("domain") == name) & (F.floor(F.col("_h") / BINS) == b), F.lit(True)) for name, b in picked.items()))
    second = base.filter(cases).groupBy("domain", "_h").agg(F.sum("n").alias("n")).collect()
    wants = dict(groups)
    for name in picked:
        total, at = before[name], picked[name] * BINS
        for h, n in sorted((r["_h"], r["n"]) for r in second if r["domain"] == name):
            if abs(total + n - wants[name]) > abs(total - wants[name]):
                break
            total, at = total + n, h + 1
        out[name] = at
    return out


def mix(docs: DataFrame, shares: DataFrame, path: str | None = None, total: float | None = None, soft: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, n_tokens, rate and copies of every document that is taken.
    report: source, target_share, max_repeats, available_tokens, mix_tokens, actual_share (of the
    source's documents), expected_share (of the domain, by posteriors), least_rate, most_rate,
    most_copies and steps of each listed source. With ``soft`` documents without a listed source count
    for the shares by their posteriors. ``total`` is the size of the mix in tokens; by default the
    largest at which all targets can be met. ``shares`` is a fixed table of few rows."""
    listed = shares.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").orderBy("s").collect()
    names = [r["s"] for r in listed]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source_name(F.col("source")).alias("_s"))
    base = base.withColumn("domain", F.when(F.col("_s").isin(names), F.col("_s")))
    sized = durable(count_tokens(base, "doc_id", "text", path, ("domain",)).withColumnRenamed("n_tokens", "n"), "sizes")
    posteriors = memberships(base.select("doc_id", "text", "domain"), names)
    own = F.transform(F.array(*map(F.lit, names)), lambda s: F.when(F.col("domain") == s, 1.0).otherwise(0.0))
    rows = (sized if soft else sized.filter("domain is not null")).join(posteriors, "doc_id")
    rows = durable(rows.filter("n > 0").withColumn("q", F.when(F.col("domain").isNull(), F.col("p")).otherwise(own)), "members")
    grouped = durable(rows.groupBy("q", "p").agg(F.sum("n").cast("double").alias("n")), "groups")
    sizes = [float(x or 0.0) for x in grouped.agg(*(F.sum(F.col("n") * F.col("q")[i]) for i in range(len(names)))).first()]
    target, caps = [float(r["target_share"]) for r in listed], [float(r["max_repeats"]) for r in listed]
    if total is None:
        total = min((c * s / t for c, s, t in zip(caps, sizes, target) if t > 0 and s > 0), default=0.0)
    m, u, steps = fit(grouped, [t * total for t in target], caps)
    # Thresholds work on documents of listed sources; of others the hash alone decides.
    rated = rows.withColumn("rate", rate_of(m, u, caps)).withColumn("_whole", F.floor("rate")).withColumn("_part", F.col("rate") - F.col("_whole"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(BINS * BINS)) / (BINS * BINS)
    # A part of a rate is taken where the place is under it; the threshold stretches all parts of a source alike.
    stretch = F.least(F.floor(place / F.col("_part") * (BINS * BINS / 4)), F.lit(BINS * BINS - 1)).cast("long")
    rated = rated.withColumn("_h", F.when(F.col("_part") > 0, stretch).otherwise(F.lit(BINS * BINS)))
    facts = {r["domain"]: r for r in rated.filter("domain is not null").groupBy("domain").agg(F.sum(F.col("n") * F.col("rate")).alias("all"), F.sum(F.col("n") * F.col("_whole")).alias("whole")).collect()}
    goal = {s: t * total if not soft else float(facts[s]["all"]) for s, t in zip(names, target) if s in facts}
    cut = _threshold(rated.filter("domain is not null and _part > 0"), [(s, min(g, c * n) - float(facts[s]["whole"])) for s, c, n in zip(names, caps, sizes) if (g := goal.get(s)) is not None])
    limit = F.coalesce(*(F.when(F.col("domain") == s, F.lit(cut.get(s, 0))) for s in names), F.lit(BINS * BINS // 4)) if names else F.lit(0)
    copies = (F.col("_whole") + F.when(F.col("_h") < limit, 1).otherwise(0)).cast("int")
    taken = rated.withColumn("copies", copies).filter("copies > 0").select("doc_id", F.col("domain").alias("source"), F.col("n").cast("long").alias("n_tokens"), F.round("rate", 6).alias("rate"), "copies", "q", "p")
    # One row a domain: what it holds by source (q) and by posteriors (p).
    weight = F.col("n_tokens") * F.col("copies")
    parts = taken.select(F.posexplode(F.arrays_zip("q", "p")).alias("_k", "_m"), "source", "rate", "copies", weight.alias("_w")).withColumn("_of", F.array(*map(F.lit, names))[F.col("_k")])
    mine = F.col("source") == F.col("_of")
    in_mix = parts.groupBy(F.col("_of").alias("source")).agg(F.sum(F.col("_w") * F.col("_m.q")).alias("_mixed"), F.sum(F.col("_w") * F.col("_m.p")).alias("_expected"), F.max(F.when(mine, F.col("copies"))).alias("most_copies"))
    whole = taken.agg(F.sum(weight).alias("_all"))
    available = rated.filter("domain is not null").groupBy(F.col("domain").alias("source")).agg(F.sum("n").alias("available_tokens"), F.round(F.min("rate"), 6).alias("least_rate"), F.round(F.max("rate"), 6).alias("most_rate"))
    plan = docs.sparkSession.createDataFrame([(s, t, int(c), steps) for s, t, c in zip(names, target, caps)], "source string, target_share double, max_repeats int, steps int")
    share = lambda c: F.coalesce(F.round(F.col(c) / F.col("_all"), 6), F.lit(0.0))
    report = plan.join(available, "source", "left").join(in_mix, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).cast("long").alias("available_tokens"), F.round(F.coalesce("_mixed", F.lit(0.0))).cast("long").alias("mix_tokens"), share("_mixed").alias("actual_share"), share("_expected").alias("expected_share"), "least_rate", "most_rate", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "steps"
    )
    return taken.drop("q", "p"), report
