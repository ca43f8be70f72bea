"""Topics whose number the fit finds: the hierarchical Dirichlet process by online variational inference (X6; Wang, Paisley and Blei, 2011)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mapweave.operators.topics import vocabulary
from mapweave.runtime import materialize, release


def _digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function: six steps up, then the asymptotic series."""
    x = np.array(x, float)
    if x.size < 4096:  # all steps at once
        moved, x = -(1 / (x[..., None] + np.arange(6))).sum(axis=-1), x + 6
    else:
        moved = np.zeros_like(x)
        for _ in range(6):
            moved -= 1 / x
            x += 1
    y = 1 / (x * x)
    return moved + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _log_sticks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected logarithms of the pieces of a stick broken by Beta(a, b) shares, the rest being the last piece."""
    broken, rest, whole = _digamma(np.array([a, b, a + b]))
    broken, rest = broken - whole, rest - whole
    return np.append(broken, 0.0) + np.insert(np.cumsum(rest), 0, 0.0)


def _shares(x: np.ndarray) -> np.ndarray:
    """Rows of logarithms as shares of 1."""
    out = np.exp(x - x.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True)


def _above(x: np.ndarray) -> np.ndarray:
    """For each piece but the last the sum of the pieces after it."""
    return x[::-1].cumsum()[::-1][1:]


def fit_document(counts: np.ndarray, words: np.ndarray, topics: np.ndarray, pieces: int, alpha: float, rounds: int = 30, rest: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """(which, whose): which corpus topic each of a document's own topics is, and the own topic of each of its distinct words, as shares.

    words holds the expected log probability of the document's words by corpus topic, topics the expected log weight of these. The own
    topics start as the corpus topics that explain the words best one by one. Rounds end when no word's shares move by more than `rest`.
    """
    alone = _shares((words + topics[:, None]).T)
    first = np.argsort(-(counts @ alone), kind="stable")[:pieces]
    which = np.full((len(first), len(topics)), 1e-3 / len(topics))
    which[np.arange(len(first)), first] += 1 - 1e-3
    whose = _shares((which @ words).T)
    for _ in range(rounds):
        held = counts @ whose
        own = _log_sticks(1 + held[:-1], alpha + _above(held))
        before, whose = whose, _shares((which @ words).T + own)
        which = _shares((whose * counts[:, None]).T @ words.T + topics)
        if np.abs(whose - before).max() <= rest:
            break
    return which, whose


def hdp(documents: DataFrame, most_topics: int = 50, pieces: int = 10, min_df: float = 5, max_df: float = 0.7, most: int = 100_000, gamma: float = 1.0, alpha: float = 1.0, eta: float = 1.0,
        batches: int = 4, offset: float = 1.0, decay: float = 0.6, max_passes: int = 100, tolerance: float = 0.01, least_share: float = 0.01, top: int = 100, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """((doc_id, topic, prob), (topic, share, word, prob)) of (doc_id, words): as many topics as the documents ask for.

    Each document breaks a stick of its own into `pieces` shares of topics that it draws from a common stick of at most most_topics pieces. A step fits the documents of one batch in tasks, sums what
    they say of each word and topic, and moves the common topics towards it by (offset + step)^-decay; batches are made by hash, and a pass is one step for
    each. Passes end when the topics' shares of all words move by less than the tolerance altogether; it is an error if that takes more than max_passes, or if
    all most_topics pieces are in use. Topics with less than least_share of all words aren't there; the others are numbered from 0 by falling share.

    The driver holds, and tasks get, a table of most_topics x `most` numbers; words come from vocabulary(). Documents that hold none of
    these words, or are null, have no topics. A smaller eta splits themes into more topics of fewer words. Rows of one doc_id are documents of their own with the same id; a null doc_id is kept.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "words").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "documents", collect=False)
    known = vocabulary(rows, min_df, max_df, most)
    vocabulary_sent = spark.sparkContext.broadcast(known)  # at most `most` words
    doc_kind = rows.schema["doc_id"].dataType

    def bagged(batches):
        """The numbers of each document's known words in order, and how often it holds them; documents without any are left out."""
        numbers = pa.array(vocabulary_sent.value, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = part.column("words")
                size = np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False)).astype(np.int64)
                found = pc.index_in(words.flatten(), value_set=numbers)
                there = found.is_valid().to_numpy(zero_copy_only=False)
                keys = np.repeat(np.arange(len(size)), size)[there] * max(len(numbers), 1) + found.drop_null().to_numpy().astype(np.int64)
                cells, counts = np.unique(keys, return_counts=True)
                own, word = np.divmod(cells, max(len(numbers), 1))
                held = np.bincount(own, minlength=len(size))
                kept, ends = pa.array(held > 0), pa.array(np.append(0, np.cumsum(held[held > 0])), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(word, pa.int32()), pa.array(counts.astype(float)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").filter(kept), *lists, part.column("row").filter(kept)], ["doc_id", "ids", "counts", "row"])

    bags = rows.mapInArrow(bagged, f"doc_id {doc_kind.simpleString()}, ids array<int>, counts array<double>, row long")
    bags = bags.select("doc_id", "ids", "counts", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int").alias("batch"))
    # small next to what a fit does with it, so every batch is dealt out evenly over all cores
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bags = materialize(bags.repartition(cores), "bags", "batch", collect=False)
    sizes = {r.batch: r.n for r in bags.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    n, width = sum(sizes.values()), len(known)
    held_names = [f"t{i}" for i in range(most_topics)]
    if not n:
        none = "doc_id long, topic int, prob double", "topic int, share double, word string, prob double"
        return tuple(spark.createDataFrame([], schema) for schema in none)
    words_in_all = bags.agg(F.sum(F.aggregate("counts", F.lit(0.0), lambda a, b: a + b))).first()[0]
    g = np.random.default_rng(seed)
    table = eta + g.gamma(1.0, 1.0, (most_topics, width)) * words_in_all / (most_topics * width)
    drawn = np.ones(most_topics)
    shares, step = np.full(most_topics, 1 / most_topics), 0

    def common() -> tuple[np.ndarray, np.ndarray]:
        sticks = _log_sticks(1 + drawn[:-1], gamma + _above(drawn))
        return np.ascontiguousarray((_digamma(table) - _digamma(table.sum(axis=1))[:, None]).T, np.float32), sticks  # a word's topics lie side by side

    def bags_of(batch):
        """(numbers, counts) of the words of each document."""
        ids, counts = (batch.column(c).flatten().to_numpy() for c in ("ids", "counts"))
        ends = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy())
        return zip(np.split(ids, ends[:-1]), np.split(counts, ends[:-1]), strict=True)

    def fits(sent):
        def run(batches):
            log_words, sticks = sent.value
            total, seen, uses = np.zeros(log_words.shape), np.zeros(len(log_words), bool), np.zeros(len(sticks))
            for batch in batches:
                for ids, counts in bags_of(batch):
                    which, whose = fit_document(counts, log_words[ids].T.astype(float), sticks, pieces, alpha)
                    uses += which.sum(axis=0)
                    total[ids] += (whose * counts[:, None]) @ which  # the words of a bag are distinct
                    seen[ids] = True
            there = np.flatnonzero(seen)
            for at in range(0, len(there), 4096):
                part = there[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(total[part, t]) for t in range(len(sticks)))], ["i", *held_names])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([x]) for x in uses)], ["i", *held_names])

        return run

    summed = [F.sum(t).alias(t) for t in held_names]
    schema = "i int, " + ", ".join(f"{t} double" for t in held_names)
    for _ in range(max_passes):
        for b, size in sizes.items():
            sent = spark.sparkContext.broadcast(common())  # most_topics x `most` numbers
            told = bags.filter(F.col("batch") == b).select("ids", "counts").mapInArrow(fits(sent), schema).groupBy("i").agg(*summed).toArrow()  # at most `most` rows
            sent.destroy()
            found, at, said = np.zeros_like(table), told["i"].to_numpy(), np.array([told[t].to_numpy() for t in held_names])
            found[:, at[at >= 0]] = said[:, at >= 0]
            uses = said[:, at < 0].sum(axis=1)
            rate = (offset + step) ** -decay
            step += 1
            table = (1 - rate) * table + rate * (eta + found * n / size)
            drawn = (1 - rate) * drawn + rate * uses * n / size
            order = np.argsort(-table.sum(axis=1), kind="stable")
            table, drawn = table[order], drawn[order]
        held = (table - eta).sum(axis=1)
        moved, shares = np.abs(held / held.sum() - shares).sum(), held / held.sum()
        if moved <= tolerance:
            break
    else:
        raise RuntimeError(f"shares of topics still move by {moved:.2g} after {max_passes} passes")
    kept = int((shares >= least_share).sum())
    if kept == most_topics:
        raise RuntimeError(f"all {most_topics} topics are in use: allow more")
    sent = spark.sparkContext.broadcast(common())
    kind = to_arrow_type(bags.schema["doc_id"].dataType)

    def mixtures(batches):
        log_words, sticks = sent.value
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, (ids, counts) in zip(batch.column("doc_id").to_pylist(), bags_of(batch), strict=True):
                which, whose = fit_document(counts, log_words[ids].T.astype(float), sticks, pieces, alpha)
                mix = (counts @ whose) @ which
                for t in np.flatnonzero(mix[:kept] >= 0.01 * mix.sum()):
                    for column, value in zip(out, (doc, int(t), float(mix[t] / mix.sum())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], kind), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], ["doc_id", "topic", "prob"])

    mixed = materialize(bags.select("doc_id", "ids", "counts").mapInArrow(mixtures, f"doc_id {bags.schema['doc_id'].dataType.simpleString()}, topic int, prob double"), "mixtures", collect=False)
    release(rows, bags)
    probs = table[:kept] / table[:kept].sum(axis=1, keepdims=True)
    best = [(t, float(shares[t]), known[i], float(probs[t, i])) for t in range(kept) for i in sorted(range(width), key=lambda i: (-probs[t, i], known[i]))[:top]]
    return mixed, spark.createDataFrame(best, "topic int, share double, word string, prob double")
