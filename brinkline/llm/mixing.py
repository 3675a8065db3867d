"""Mixing sources to target weights by soft membership, in DataFrame functions alone.

Labelled rows teach a classifier: naive Bayes over hashed beginnings and endings of words, whose counts come from one
aggregation. A document's score of a domain is the mean log weight of its features times as many of them as count as
independent evidence; the posteriors follow. Document rates r >= least_rate are then fitted so that the expected
tokens of each domain, sum of r * tokens * posterior, meet the targets: projected gradient on least squares. A step is
scaled by the Gram matrix of the posteriors of those rates that may move, and of a few lengths the best is taken; the
plain step, by the Gram matrix of all, always is a valid one. A pass returns one small matrix to the driver; a
document's rate is replayed from the steps so far, so nothing is kept per row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinkline.plans.shared import materialize, shared_root

WORD = r"[^\x20\x09-\x0D]+"


def _features(rows: DataFrame, buckets: int) -> DataFrame:
    """A row for each feature of each row: its bucket, by the first three or the last two characters of a word in lower case.

    ``rows`` has ``text``, in whose place come ``n_tokens`` and ``bucket``; rows without words stay, with a null bucket.
    """
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    kept = [c for c in rows.columns if c != "text"]
    each = rows.withColumn("words", words).select(*kept, F.size("words").cast("long").alias("n_tokens"), F.explode_outer("words").alias("word"))
    low = F.lower("word")
    slot = lambda part, salt: F.pmod(F.xxhash64(part, F.lit(salt)), F.lit(buckets))
    both = F.array(slot(F.substring(low, 1, 3), 1), slot(F.substring(low, -2, 2), 2))
    return each.select(*kept, "n_tokens", F.explode(F.when(F.col("word").isNull(), F.array(F.lit(None).cast("long"))).otherwise(both)).alias("bucket"))


def classifier(texts: DataFrame, buckets: int, smooth: float, most_domains: int) -> tuple[list[str], list[float], DataFrame, list[float]]:
    """(domains, log priors, weights (bucket, w0, w1, ...), a missing bucket's weights) learned from ``texts`` (domain, text).

    One row a domain reaches the driver; the weights stay a table of at most ``buckets`` rows.
    """
    rows = texts.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").limit(most_domains + 1).collect()
    if len(rows) > most_domains:
        raise ValueError(f"more than {most_domains} domains")
    if not rows:
        return [], [], texts, []
    names, total = [r.domain for r in rows], sum(r.n for r in rows)
    priors = [float(np.log(r.n / total)) for r in rows]
    counts = _features(texts, buckets).where("bucket is not null").groupBy("bucket", "domain").agg(F.count("*").alias("n"))
    counts = materialize(counts, shared_root(texts.sparkSession), "counts")
    sums = {r.domain: r.n for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    of = lambda n, d: F.log((F.coalesce(n, F.lit(0)) + F.lit(smooth)) / F.lit(sums.get(d, 0) + smooth * buckets))
    table = counts.groupBy("bucket").agg(*[of(F.sum(F.when(F.col("domain") == d, F.col("n"))), d).alias(f"w{i}") for i, d in enumerate(names)])
    return names, priors, table, [float(np.log(smooth / (sums.get(d, 0) + smooth * buckets))) for d in names]


def posteriors(rows: DataFrame, model: tuple[list[str], list[float], DataFrame, list[float]], buckets: int, evidence: float) -> DataFrame:
    """(doc_id, n_tokens, m, p) for the different rows of ``rows`` (doc_id, text): how often each occurs and its posteriors.

    Words are summed where they are read, so that a row a document is shuffled, whatever its length. ``evidence``
    bounds how many of a text's features count as independent.
    """
    names, priors, weights, missing = model
    told = rows.withColumn("same", F.xxhash64(F.coalesce("text", F.lit(""))))
    each = _features(told, buckets).join(F.broadcast(weights), "bucket", "left")
    there = F.count("bucket")
    sums = [F.sum(F.when(F.col("bucket").isNotNull(), F.coalesce(f"w{i}", F.lit(x)))).alias(f"s{i}") for i, x in enumerate(missing)]
    found = each.groupBy("doc_id", "same", "n_tokens").agg(F.count("*").alias("n"), there.alias("there"), *sums)
    strength = F.least(2.0 * F.col("n_tokens"), F.lit(float(evidence))) / F.greatest("there", F.lit(1))
    scored = found.select(
        "doc_id", "n_tokens", (F.col("n") / F.greatest(2 * F.col("n_tokens"), F.lit(1))).cast("long").alias("m"), *[(F.coalesce(f"s{i}", F.lit(0.0)) * strength + F.lit(x)).alias(f"s{i}") for i, x in enumerate(priors)]
    )
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(names))]) if len(names) > 1 else F.col("s0")
    raised = scored.withColumn("top", top).select("doc_id", "n_tokens", "m", *[F.exp(F.col(f"s{i}") - F.col("top")).alias(f"e{i}") for i in range(len(names))])
    total = sum((F.col(f"e{i}") for i in range(len(names))), F.lit(0.0))
    return raised.withColumn("total", total).select("doc_id", "n_tokens", "m", F.array(*[F.col(f"e{i}") / F.col("total") for i in range(len(names))]).alias("p"))


def _replayed(steps: list[list[float]], least_rate: float) -> Column:
    """Rate of a row after the given steps: r -> max(least_rate, r - p . step), from 1."""
    if not steps:
        return F.lit(1.0)
    rate = F.lit(max(1.0, least_rate))
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(
        history,
        rate,
        lambda r, s: F.greatest(F.lit(float(least_rate)), r - F.aggregate(F.zip_with(F.col("p"), s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)),
    )


def _dot(name: str, x: np.ndarray) -> Column:
    return sum((F.col(name)[i] * float(v) for i, v in enumerate(x)), F.lit(0.0))


def mix_to_targets(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float] | None = None,
    flatten: float = 0.3,
    low_share: float = 0.5,
    least_rate: float = 0.0,
    passes: int = 12,
    evidence: float = 12.0,
    smooth: float = 0.5,
    buckets: int = 8192,
    tolerance: float = 1e-4,
    fit_rows: int = 100_000,
    most_domains: int = 64,
) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), p (posteriors), rate, copies, residual and settled of every row of ``docs`` (doc_id, text).

    ``labelled`` (doc_id, domain) rows teach the classifier: about ``fit_rows`` of them at most, taken by a hash of the
    doc_id; null domains are ignored, of several domains of a doc_id the first in order counts, and more than
    ``most_domains`` different ones are refused. ``targets`` gives the wanted share of expected tokens by domain;
    without it, domains ending in ``/0`` keep ``low_share`` of their tokens and the others are evened out by the power
    ``flatten``. copies is the rate rounded up or down at random by a hash of doc_id, so that its expectation is the
    rate. residual, the same in all rows, is the distance of the expected tokens from the goal as a share of the goal.
    It is at most ``tolerance`` unless ``least_rate`` or zero keeps rates from meeting the goal: then steps go on until
    none changes the totals by more than ``tolerance`` of the goal. settled tells whether ``passes`` steps sufficed for
    either. Null and empty texts have no tokens and the prior's posteriors; without labelled rows rate and copies are
    1 and domain, p and residual null. Repeated rows are rated alike; extra columns are ignored; an empty table gives
    an empty result.
    """
    root = shared_root(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    share = min(1.0, fit_rows / max(1, known.count()))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) / 1_000_000
    texts = rows.join(F.broadcast(known.where(dice < share)), "doc_id").select("domain", "text")
    model = classifier(texts, buckets, smooth, most_domains)
    names = model[0]
    if not names:
        none = rows.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))
        return none.select("doc_id", "n_tokens", F.lit(None).cast("string").alias("domain"), F.lit(None).cast("array<double>").alias("p"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(None).cast("double").alias("residual"), F.lit(True).alias("settled"))
    soft = materialize(posteriors(rows, model, buckets, evidence), root, "soft")
    d = len(names)
    mass = F.col("m") * F.col("n_tokens")
    cells = [F.sum(mass * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]
    sums = soft.agg(*cells, *[F.sum(mass * F.col("p")[i]).alias(f"n{i}") for i in range(d)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
    now = np.array([sums[f"n{i}"] or 0.0 for i in range(d)])
    if targets is not None:
        goal = now.sum() * np.array([targets.get(n, 0.0) for n in names]) / max(1e-12, sum(targets.get(n, 0.0) for n in names))
    else:
        low = np.array([n.endswith("/0") for n in names])
        most = max([x for x, z in zip(now, low, strict=True) if not z], default=1.0)
        goal = np.where(low, low_share * now, now * (most / np.maximum(now, 1e-9)) ** flatten)
    inverse, scale = np.linalg.pinv(gram, rcond=1e-8, hermitian=True), max(1.0, float(goal.sum()))
    steps: list[list[float]] = []
    expected = now * max(1.0, least_rate)
    off = lambda e: float((e - goal) @ inverse @ (e - goal))
    settled = False
    while len(steps) < passes:
        rated = soft.select(mass.alias("mass"), "p", _replayed(steps, least_rate).alias("r"))
        # rates that may move: those above the bound, and those that the gradient raises
        slope = _dot("p", inverse @ (expected - goal))
        free = rated.where((F.col("r") > least_rate) | (slope < 0))
        row = free.agg(*[F.sum(F.col("mass") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
        loose = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)])
        scaled = np.linalg.pinv(loose @ inverse @ loose, rcond=1e-10, hermitian=True) @ (loose @ inverse @ (expected - goal))
        plain = inverse @ (expected - goal)
        tried = [t * scaled for t in (1.0, 0.5, 0.25, 0.1)] + [plain]
        moved = [F.greatest(F.lit(float(least_rate)), F.col("r") - _dot("p", x)) for x in tried]
        row = rated.agg(*[F.sum(m * F.col("mass") * F.col("p")[i]).alias(f"e{k}_{i}") for k, m in enumerate(moved) for i in range(d)]).first()
        ends = [np.array([row[f"e{k}_{i}"] or 0.0 for i in range(d)]) for k in range(len(tried))]
        k = min(range(len(tried)), key=lambda k: off(ends[k]))
        settled = off(ends[k]) >= off(expected) or np.abs(ends[k] - expected).sum() <= tolerance * scale
        if settled:
            break
        steps.append(tried[k].tolist())
        expected = ends[k]
        settled = np.abs(expected - goal).sum() <= tolerance * scale
        if settled:
            break
    best = F.array_position("p", F.array_max("p"))
    copies = F.floor(F.col("rate") + F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)).cast("int")
    rated = soft.select("doc_id", "n_tokens", F.element_at(F.array(*[F.lit(n) for n in names]), best.cast("int")).alias("domain"), "p", _replayed(steps, least_rate).alias("rate"), "m")
    rated = rated.withColumn("copies", copies).withColumn("residual", F.lit(float(np.abs(expected - goal).sum() / scale))).withColumn("settled", F.lit(bool(settled)))
    return rated.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")


def repeated(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as ``rates`` (doc_id, copies) says; a doc_id of several rows shares one entry."""
    one = rates.groupBy("doc_id").agg(F.max("copies").alias("brinkline_copies"))
    joined = docs.join(one, docs["doc_id"].eqNullSafe(one["doc_id"])).drop(one["doc_id"])
    many = joined.where("brinkline_copies > 0").withColumn("brinkline_copy", F.explode(F.sequence(F.lit(1), F.col("brinkline_copies"))))
    return many.drop("brinkline_copies", "brinkline_copy")
