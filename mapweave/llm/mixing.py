"""Operator 4, mixing to target weights with soft membership.

DataFrame expressions only. A Bernoulli naive-Bayes classifier learns from a labelled table which words (hashed to a fixed number
of buckets) tell the domains apart, and gives every document posterior domain shares p_id. Rates r_i >= 0 are then fitted
so that the expected token totals S_d = sum_i r_i * tokens_i * p_id come to the targets t_d: projected gradient
descent on sum_d (S_d - t_d)**2 / (2 A_d), where A_d is S_d at rate 1, in the metric that weighs documents by their tokens.
There a step of 1 can't overshoot: r_i <- max(0, y_i - sum_d p_id (S_d - t_d) / A_d), where y_i is r_i moved on by a momentum. A step is one
aggregation over a table of tokens and shares; only the D totals reach the driver. As a rate follows from its
document's shares and the history of residuals, it is only stored every REPLAYED steps.
"""

from __future__ import annotations

import json
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.runtime import materialize, release

BUCKETS = 1 << 15


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], most_labelled: int = 20_000, min_z: float = 6.0, min_share: float = 0.02, shrink: float = 10.0) -> tuple[list[float], np.ndarray]:
    """Log odds of a text without any telling word, and what each word adds for each domain.

    Fitted on labelled rows of docs: all of them, or the most_labelled ones with the smallest hashes of their ids.

    A bucket counts once for a document. It has weights only where its share of documents in some domain but the largest exceeds
    that elsewhere by min_z standard errors and is min_share or more, so that words that say nothing don't add noise
    to long texts and those of a few copies say little; a share is drawn to the overall one as if by `shrink` documents.
    """
    known = labelled.select("doc_id", "domain").filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most most_labelled rows
    per = [F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)]
    sizes = np.array(rows.agg(*per).first(), float)
    buckets = F.array_distinct(F.transform(_words("text"), _bucket))
    table = rows.select("domain", F.explode(buckets).alias("bucket")).groupBy("bucket").agg(*per).toArrow()
    counts = np.zeros((BUCKETS, len(domains)))
    if table.num_rows:
        counts[table["bucket"].to_numpy()] = np.column_stack([table[f"d{i}"].to_numpy() for i in range(len(domains))])
    total = counts.sum(axis=1)
    common = (total + 0.5) / (sizes.sum() + 1)
    shares, telling = np.tile(common, (len(domains), 1)), np.zeros(BUCKETS, bool)
    for i in range(len(domains)):
        n, m = sizes[i], sizes.sum() - sizes[i]
        if n and m:
            here, there = (counts[:, i] + 0.5) / (n + 1), (total - counts[:, i] + 0.5) / (m + 1)
            far = here - there >= min_z * np.sqrt(common * (1 - np.minimum(common, 1)) * (1 / n + 1 / m))
            telling |= far & (here >= min_share) & (i != sizes.argmax())
            shares[i] = (counts[:, i] + shrink * common) / (n + shrink)
    odds = lambda p: np.log(p / (1 - p))
    shares, common = np.minimum(shares, 1 - 1e-6), np.minimum(common, 1 - 1e-6)
    weights = np.where(telling, odds(shares) - odds(common), 0)
    absent = np.where(telling, np.log((1 - shares) / (1 - common)), 0).sum(axis=1)
    priors = [log((s + 1) / (sizes.sum() + len(domains))) + a for s, a in zip(sizes, absent.tolist(), strict=True)]
    return priors, weights.round(4)


def posteriors(docs: DataFrame, domains: list[str], priors: list[float], weights: np.ndarray) -> DataFrame:
    """docs with tokens (words of text) and shares (an array of posteriors in the order of domains)."""
    words, buckets = "__words", "__buckets"
    known = F.array(*(F.from_json(F.lit(json.dumps(w.tolist())), "array<double>") for w in weights))
    rows = docs.withColumn(words, F.coalesce(_words("text"), F.array().cast("array<string>")))
    rows = rows.withColumn("tokens", F.size(words).cast("long")).withColumn(buckets, F.array_distinct(F.transform(words, _bucket))).drop(words)
    score = lambda i: F.lit(priors[i]) + F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.element_at(F.element_at(known, i + 1), b + 1))
    scores = F.array(*(score(i) for i in range(len(domains))))
    over = lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    rows = rows.withColumn("shares", scores).withColumn("shares", over(F.col("shares")))
    total = F.aggregate("shares", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("shares", F.transform("shares", lambda x: x / total)).drop(buckets)


#: Steps whose residuals are replayed for each row before its state is written.
REPLAYED = 24


def _stepped(history: list[tuple[list[float], float]]) -> Column:
    """struct(r, y) after these steps (residuals, momentum), from the row's r and y: r is the rate, y the one moved on by the momentum."""
    start = F.struct(F.col("__r").alias("r"), F.col("__y").alias("y"))
    if not history:
        return start
    steps = F.from_json(F.lit(json.dumps([{"e": e, "m": m} for e, m in history])), "array<struct<e:array<double>,m:double>>")
    dot = lambda e: F.aggregate(F.zip_with("shares", e, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    zero = F.lit(0.0)

    def step(state: Column, s: Column) -> Column:
        moved = F.greatest(zero, state["y"] - dot(s["e"]))
        return F.struct(moved.alias("r"), F.greatest(zero, moved + s["m"] * (moved - state["r"])).alias("y"))

    return F.aggregate(steps, start, step)


def fit_rates(rows: DataFrame, targets: list[float], tolerance: float = 5e-4, max_steps: int = 1000) -> DataFrame:
    """rows (tokens, shares and more) with a rate each, which bring the token totals to the targets.

    Projected gradients with momentum. Steps end when every total is within tolerance of its target, or when rates no longer move the
    totals: then no rates that aren't negative come closer, as where every document is half of either domain. Raises an error where
    max_steps aren't enough for either. A domain without tokens can't be filled; it is left out.
    """
    state = rows.withColumn("__r", F.lit(1.0)).withColumn("__y", F.lit(1.0))
    history: list[tuple[list[float], float]] = []
    base = before = None
    still = 0
    whole = max(sum(targets), 1e-300)
    t = 1.0
    for _ in range(max_steps):
        part = lambda i: F.coalesce(F.sum(F.col("y") * F.col("tokens") * F.element_at("shares", i + 1)), F.lit(0.0))
        sums = list(state.select("tokens", "shares", _stepped(history)["y"].alias("y")).agg(*(part(i).alias(f"s{i}") for i in range(len(targets)))).first())
        base = base or sums
        gaps = [(s - t) / a if a > 0 else 0.0 for s, t, a in zip(sums, targets, base, strict=True)]
        near = max((abs(s - t) for s, t, a in zip(sums, targets, base, strict=True) if a > 0 or t == 0), default=0.0) <= tolerance * whole
        still = still + 1 if before is not None and max(abs(x - y) for x, y in zip(sums, before, strict=True)) <= 1e-6 * whole else 0
        if near or still == 3:
            return state.withColumn("rate", _stepped(history)["y"]).drop("__r", "__y")
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if before is not None and sum(g * (x - y) for g, x, y in zip(gaps, sums, before, strict=True)) > 0:
            t = after = 1.0  # the momentum leads away from the targets
        history.append((gaps, (t - 1) / after))
        before, t = sums, after
        if len(history) == REPLAYED:
            moved = state.withColumn("__s", _stepped(history)).withColumn("__r", F.col("__s.r")).withColumn("__y", F.col("__s.y")).drop("__s")
            before_it, state, history = state, materialize(moved, "rates"), []
            release(before_it)
    raise RuntimeError(f"rates didn't settle in {max_steps} steps: totals {sums}, targets {targets}")


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: dict[str, float],
    anchor: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, tokens, share_<domain>..., rate) and the columns in keep, for each row of docs.

    weights gives each domain its part of all tokens (scaled to sum 1). The total stays as it is; with anchor, it is such that this
    domain's tokens stay as they are. labelled has doc_id and domain; rows with other domains are ignored. A null or empty
    text has no tokens and the shares of a text without telling words. Without labelled rows all shares are equal. Extra columns don't enter.
    """
    domains = sorted(weights)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"__keep_{c}") for c in keep))
    rows = posteriors(own, domains, *fit_domains(own, labelled, domains)).drop("text")
    rows = materialize(rows, "shares")
    sums = rows.agg(*(F.coalesce(F.sum(F.col("tokens") * F.element_at("shares", i + 1)), F.lit(0.0)) for i in range(len(domains)))).first()
    part = {d: weights[d] / sum(weights.values()) for d in domains}
    total = sums[domains.index(anchor)] / part[anchor] if anchor else sum(sums)
    fitted = fit_rates(rows, [total * part[d] for d in domains])
    return fitted.select(
        "doc_id",
        *(F.col(f"__keep_{c}").alias(c) for c in keep),
        "tokens",
        *(F.element_at("shares", i + 1).alias(f"share_{d}") for i, d in enumerate(domains)),
        "rate",
    )


def copies(rate: Column, *identity: str, seed: int = 17) -> Column:
    """How often a document enters a mix: its rate, rounded up or down by a hash of its identity so that the expectation is right."""
    u = F.pmod(F.xxhash64(*identity, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def sampled(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], anchor: str | None, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as its rate says; rows that repeat an id share a rate. Null ids stay once."""
    rates = mix(docs, labelled, weights, anchor, id_col).groupBy("doc_id").agg(F.max("rate").alias("__rate"))
    joined = docs.select(*columns, F.col(id_col).alias("__id")).join(rates.withColumnRenamed("doc_id", "__id"), "__id", "left")
    times = F.coalesce(copies(F.col("__rate"), "__id"), F.lit(1))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*columns)


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a table of quality and toxic marks: toxic before junk before clean; conflicting rows count as the worst."""
    worst = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return worst.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain"))
