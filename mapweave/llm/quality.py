"""Operator 3, quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text give a logistic model of shape features: what a text is made of, how
much it repeats, how long its words and lines are. No word identities, languages or sources enter.
Training minimises the non-negative unbiased risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

by Newton steps; each step sums gradients and curvatures over all trusted and all unlabelled rows where they lie.
The class prior is estimated before: among the rows that a first model (trusted against unlabelled) scores above a
threshold, unlabelled mass over trusted mass is the prior times one where no negatives score so high; the least upper
confidence bound over the thresholds is taken. The rows are in halves, and each half is scored by the first model of the other.
Weights have a normal prior distribution (`WEIGHT_VARIANCE`), which counts where there are few trusted rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.kernels import Words, chunks, range_hashes
from mapweave.runtime import materialize

_CLASSES = ["lower", "upper", "digit", "stop", "symbol", "shout", "bar", "bracket", "space", "line", "control", "other"]
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _bytes in {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".,;:-",
    "symbol": b"*#%&$@^~=<>\\_+`",
    "shout": b"!?",
    "bar": b"|\t/",
    "bracket": b"()[]{}\"'",
    "space": b" ",
    "line": b"\n\r",
    "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
_LETTER = np.isin(_CLASS, [_CLASSES.index("lower"), _CLASSES.index("upper"), _CLASSES.index("other")])
_ODD_END = np.isin(_CLASS, [_CLASSES.index(x) for x in ("symbol", "shout", "bar")])
#: The weights' variance before any row is seen; the penalty of a mean risk over n trusted rows is 1 / (n * variance), LEAST_RIDGE at least.
WEIGHT_VARIANCE, LEAST_RIDGE = 1 / 3, 0.01
#: Cuts at which a share also enters as an indicator, so that the model is additive in steps of each share.
_CUTS = (0.02, 0.1, 0.3, 0.6)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct hashes of each row (by 44 bits)."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> np.uint64(44)).astype(np.int64), minlength=n_rows)


def shape_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of shares between 0 and about 1 for each text."""
    n = len(offsets) - 1
    row_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    kinds = _CLASS[data]
    counts = np.bincount(row_of_byte * 16 + kinds, minlength=16 * n).reshape(n, 16)[:, : len(_CLASSES)].astype(float)
    size = np.maximum(np.diff(offsets), 1)
    by = dict(zip(_CLASSES, counts.T, strict=True))
    letters = np.maximum(by["lower"] + by["upper"] + by["other"], 1)

    words = Words(data, offsets, lower=False)
    hashes = words.hashes()
    n_words = np.diff(words.bounds)
    some = np.maximum(n_words, 1)
    row = np.repeat(np.arange(n), n_words)
    per_row = lambda x: np.bincount(row, x, minlength=n)
    length = (words.ends - words.starts).astype(float)
    sums = lambda table: np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    inside = lambda s: s[words.ends] - s[words.starts]
    n_letters, n_upper = inside(sums(_LETTER)), inside(sums(_CLASS == _CLASSES.index("upper")))
    again = np.zeros(len(row))
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    grams = words.grams(3, hashes)
    whole = np.arange(len(row)) + 3 <= words.bounds[row + 1] if len(row) else np.zeros(0, bool)
    n_grams = np.bincount(row[whole], minlength=n)
    mean = per_row(length) / some
    first_byte, last_byte = (data[words.starts], data[words.ends - 1]) if len(row) else (data[:0], data[:0])

    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.append(starts[1:], len(data))
    ends = np.where((ends > 0) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(data) else ends
    filled = (ends > starts) & (starts < len(data))
    starts, ends = starts[filled], ends[filled]
    line_row = row_of_byte[starts] if len(starts) else np.zeros(0, np.int64)
    n_lines = np.bincount(line_row, minlength=n)

    return np.column_stack(
        [
            by["upper"] / letters,
            by["digit"] / size,
            by["other"] / size,
            np.minimum(by["stop"] / some, 2) / 2,
            by["symbol"] / size,
            by["shout"] / size,
            by["bar"] / size,
            by["bracket"] / size,
            by["control"] / size,
            per_row(again) / some,
            1 - _distinct(row, hashes, n) / some,
            np.where(n_grams > 0, 1 - _distinct(row[whole], grams[whole], n) / np.maximum(n_grams, 1), 0),
            np.where(n_lines > 0, 1 - _distinct(line_row, range_hashes(data, starts, ends), n) / np.maximum(n_lines, 1), 0),
            per_row((length <= 3) * 1.0) / some,
            per_row((length >= 13) * 1.0) / some,
            per_row(_ODD_END[last_byte] * 1.0) / some,
            per_row((_CLASS[first_byte] == _CLASSES.index("upper")) * 1.0) / some,
            per_row((n_letters == 0) * 1.0) / some,
            per_row(((n_upper >= 2) & (n_upper == n_letters)) * 1.0) / some,
            np.minimum(mean / 16, 2),
            np.minimum(np.sqrt(np.maximum(per_row(length**2) / some - mean**2, 0)) / 8, 2),
            np.log1p(n_words) / 12,
            np.log1p(n_words / np.maximum(n_lines, 1)) / 12,
            n_words < 5,
            n_words < 20,
        ]
    ).astype(np.float32)


N_SHAPES = 25


def design(shapes: np.ndarray) -> np.ndarray:
    """The model's columns: a constant, the shares, their roots, and indicators of the cuts."""
    x = shapes.astype(np.float64)
    steps = x[:, :23]
    return np.hstack([np.ones((len(x), 1)), x, np.sqrt(steps), *(steps[:, :19] > c for c in _CUTS)])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shapes) of each row; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in chunks(batch.column(1)):
                rows = shape_features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "shapes"]
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, shapes binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return design(np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, N_SHAPES))


def _sums(rows: DataFrame, task) -> np.ndarray:
    """Sum over all rows of task(X), an array of fixed length: one array a task, then one sum for each place."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = task(_matrix(batch.column(0).slice(at, 4096)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total)], ["place", "value"])

    table = rows.select("shapes").mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(max(table["place"].to_pylist(), default=-1)) + 1)
    out[table["place"].to_numpy()] = table["value"].to_numpy()
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _moments(w: np.ndarray):
    """Task: count, sums of x, losses either way, sum of s*x and of s*(1-s)*x*x' under weights w."""

    def task(x: np.ndarray) -> np.ndarray:
        g = x @ w
        s = _sigmoid(g)
        return np.concatenate([[len(x), _softplus(-g).sum(), _softplus(g).sum()], x.sum(axis=0), x.T @ s, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

    return task


@dataclass
class _Moments:
    n: float
    loss_as_positive: float
    loss_as_negative: float
    mean: np.ndarray
    mean_s: np.ndarray
    curve: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, w: np.ndarray) -> _Moments:
        v, d = _sums(rows, _moments(w)), len(w)
        if not len(v):
            return cls(0, 0, 0, np.zeros(d), np.zeros(d), np.zeros((d, d)))
        n = v[0]
        return cls(n, v[1] / n, v[2] / n, v[3 : 3 + d] / n, v[3 + d : 3 + 2 * d] / n, v[3 + 2 * d :].reshape(d, d) / n)


def _newton(parts, dims: int, ridge: float, steps: int, tolerance: float = 1e-3) -> np.ndarray:
    """Minimise a risk. parts(w) gives (risk, gradient, curvature, whether the step went too far)."""
    penalty = np.full(dims, ridge)
    penalty[0] = 1e-9
    w, step = np.zeros(dims), np.zeros(dims)
    best = np.inf
    for _ in range(steps):
        risk, gradient, curve, too_far = parts(w)
        risk += 0.5 * penalty @ w**2
        if (risk > best + 1e-9 or too_far) and np.abs(step).max() > 1e-6:
            step = step / 2
            w = w - step
            continue
        if best - risk < tolerance * 1e-2 and np.isfinite(best):
            break
        best = risk
        step = -np.linalg.solve(curve + np.diag(penalty), gradient + penalty * w)
        step *= min(1.0, 20 / max(np.abs(step).max(), 1e-12))
        w = w + step
    return w


def _first_model(trusted: DataFrame, unlabelled: DataFrame, dims: int, ridge: float, steps: int) -> np.ndarray:
    """Trusted against unlabelled, both with half of the weight."""

    def parts(w):
        p, u = _Moments.of(trusted, w), _Moments.of(unlabelled, w)
        return (p.loss_as_positive + u.loss_as_negative) / 2, (p.mean_s - p.mean + u.mean_s) / 2, (p.curve + u.curve) / 2, False

    return _newton(parts, dims, ridge, steps)


def class_prior(scored: list[tuple[DataFrame, DataFrame, np.ndarray]], bins: int = 512, chance: float = 0.05) -> float:
    """Share of positives among the unlabelled rows, from the score histograms of (trusted, unlabelled, w): rows that w wasn't fitted on."""

    def histogram(rows: DataFrame, w: np.ndarray) -> np.ndarray:
        def task(x: np.ndarray) -> np.ndarray:
            return np.bincount(np.minimum((_sigmoid(x @ w) * bins).astype(int), bins - 1), minlength=bins).astype(float)

        found = _sums(rows, task)
        return np.cumsum(found[::-1]) if len(found) else np.zeros(bins)

    p = sum((histogram(trusted, w) for trusted, _, w in scored), np.zeros(bins))
    u = sum((histogram(unlabelled, w) for _, unlabelled, w in scored), np.zeros(bins))
    if not p[-1] or not u[-1]:
        return 0.5
    spread = np.sqrt(np.log(4 / chance) / (2 * p[-1])) + np.sqrt(np.log(4 / chance) / (2 * u[-1]))
    p, u = p / p[-1], u / u[-1]
    high = p > 0
    at = np.argmin(((u + spread) / np.where(high, p, np.inf))[high])
    return float(np.clip((u[high] / p[high])[at], 0.02, 0.98))


def _risk(trusted: DataFrame, unlabelled: DataFrame, prior: float):
    def parts(w):
        p, u = _Moments.of(trusted, w), _Moments.of(unlabelled, w)
        negative = u.loss_as_negative - prior * p.loss_as_negative
        return prior * p.loss_as_positive + max(0.0, negative), u.mean_s - prior * p.mean, u.curve, negative < 0

    return parts


def fit(trusted: DataFrame, unlabelled: DataFrame, ridge: float | None = None, steps: int = 14) -> tuple[np.ndarray, float]:
    """(weights, class prior). Both tables have the columns half (0 or 1) and shapes; without trusted rows all weights are 0.

    ridge is the penalty on squared weights; unset, it follows from WEIGHT_VARIANCE.
    """
    dims = design(np.zeros((1, N_SHAPES), np.float32)).shape[1]
    n = trusted.count()
    if not n:
        return np.zeros(dims), 0.5
    ridge = max(LEAST_RIDGE, 1 / (n * WEIGHT_VARIANCE)) if ridge is None else ridge
    halves = [(trusted.filter(F.col("half") == h), unlabelled.filter(F.col("half") == h)) for h in (0, 1)]
    crossed = [(*other, _first_model(*own, dims, ridge, steps)) for own, other in (halves, halves[::-1]) if not own[0].isEmpty()]
    prior = class_prior(crossed)
    return _newton(_risk(trusted, unlabelled, prior), dims, ridge, steps), prior


def _prepared(docs: DataFrame, held_out: Column | None, id_col: str, text_col: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = F.coalesce((remainder % 3 == 1) if held_out is None else held_out, F.lit(False))
    rows = features(docs, id_col, text_col).withColumn("held_out", out)
    return materialize(rows.withColumn("half", F.coalesce((F.floor(remainder / 3) % 2).cast("int"), F.lit(0))), "shapes")


def _trained(rows: DataFrame, labels: DataFrame, label_col: str, ridge: float | None) -> np.ndarray:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("mark")).groupBy("doc_id").agg(F.min("mark").alias("mark"))
    unlabelled = rows.filter(~F.col("held_out")).select("doc_id", "half", "shapes")
    trusted = materialize(unlabelled.join(marks.filter("mark = 1"), "doc_id", "left_semi"), "trusted")
    return fit(trusted, unlabelled, ridge)[0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float | None = None) -> np.ndarray:
    """The model's weights, as score() fits them."""
    return _trained(_prepared(docs, None, id_col, text_col), labels, label_col, ridge)


def accepted(docs: DataFrame, w: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose text scores 0.5 or more under the weights.

    Null and empty texts are scored like any other; rows are judged one by one, whatever their ids.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in chunks(batch.column(place)):
                good = design(shape_features(data, offsets)) @ w >= 0
                yield batch.slice(start, end - start).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    ridge: float | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    Trusted are the documents that `labels` marks 1; the unlabelled text is that of all documents. Rows for which held_out
    (an expression over doc_id, by default crc32 of its text modulo 3 being 1) is true take no part in the fit.
    Null and empty texts are scored like any other; a null doc_id isn't held out and has no label. A document
    that is marked both ways isn't trusted. Extra columns, also ones named like the results, are ignored.
    """
    rows = _prepared(docs, held_out, id_col, text_col)
    w = _trained(rows, labels, label_col, ridge)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = _sigmoid(_matrix(part.column(2)) @ w)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
                )

    return rows.select("doc_id", "held_out", "shapes").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
