"""Operator 11, toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Each coordinate has a sum z of gradients, less what the weight's own moves have used of it, and a sum n of their squares. Its weight is

    0 where |z| <= l1, else -(z - sign(z) * l1) / ((beta + sqrt(n)) / alpha + l2)

so that steps shrink for coordinates that have moved much, and coordinates that tell nothing stay at zero. The sums are a table of
at most 2**bits rows on Spark: a step sums the gradients of one batch of documents by coordinate and joins them to that table. Only the
weights other than zero travel, to the driver and from there to tasks, and their number is checked.

Terms are words (runs of letters and digits, in lower case), pairs of neighbours, pairs with one or two words between them, and
words cut to their first letters, which is what inflected forms share. A document has a term or hasn't, however often.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.kernels import U64, Words, chunks, mix, range_hashes
from mapweave.runtime import materialize, release

#: Bytes that end a word: all of ASCII but letters and digits.
_GAP = np.arange(256, dtype=np.uint8)
_GAP[[c for c in range(128) if not chr(c).isalnum()]] = 32
#: Lengths, in letters, of the cut forms, and the numbers of words that skip-grams leave out.
CUTS, SKIPS = (4, 5), (1, 2)


def _cut_ends(data: np.ndarray, words: Words, letters: int) -> np.ndarray:
    """Where the first `letters` code points of each word end; the word's own end where it has fewer."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    before = np.cumsum(lead) - 1
    if not len(words.starts):
        return words.starts
    end = before[words.starts] + letters
    return np.minimum(np.where(end < len(at), at[np.minimum(end, len(at) - 1)], len(data)), words.ends)


def terms(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(rows, coordinates) of the terms of a chunk of lower-cased texts, kind by kind; a row may have a coordinate several times."""
    data = _GAP[data]
    words = Words(data, offsets, lower=False)
    shift, n = U64(64 - bits), len(words.starts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
    whole = words.hashes()
    place = lambda h, salt: (mix(h + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> shift).astype(np.int64)
    with np.errstate(over="ignore"):
        yield row, place(whole, 1)
        for letters in CUTS:
            ends = _cut_ends(data, words, letters)
            long = ends < words.ends
            yield row[long], place(range_hashes(data, words.starts[long], ends[long]), 10 + letters)
        for apart in (1, *(1 + s for s in SKIPS)):
            if n > apart:
                same = row[apart:] == row[:-apart]
                pair = whole[:-apart] * U64(0xD6E8FEB86659FD93) + whole[apart:]
                yield row[:-apart][same], place(pair[same], 20 + apart)


@dataclass
class Weights:
    """The weights other than zero, by coordinate, and the constant."""

    bits: int
    bias: float = 0.0
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.places] = self.values
        return out

    def margins(self, table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log-odds of each text; only terms that have a weight are looked at twice."""
        keys = [np.zeros(0, np.int64)]
        for row, place in terms(data, offsets, self.bits):
            told = table[place] != 0
            keys.append((row[told] << self.bits) | place[told])
        keys = np.unique(np.concatenate(keys))
        return self.bias + np.bincount(keys >> self.bits, table[keys & ((1 << self.bits) - 1)], len(offsets) - 1)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _gradients(rows: DataFrame, w: Weights) -> DataFrame:
    """(place, g): summed gradients of the log loss over rows (mark, places), by coordinate; place -1 is the constant."""

    def run(batches):
        table = w.table()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own, mark = part.column(1), part.column(0).to_numpy().astype(float)
                row = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
                place = own.flatten().to_numpy()
                error = _sigmoid(w.bias + np.bincount(row, table[place], len(own))) - mark
                sums = np.bincount(place, error[row], 1 << w.bits)
                seen = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(sums[seen], error.sum()))], ["place", "g"])

    return rows.select("mark", "places").mapInArrow(run, "place long, g double").groupBy("place").agg(F.sum("g").alias("g"))


def weight(z: Column, n: Column, alpha: float, beta: float, l1: Column, l2: float) -> Column:
    """The proximal step in closed form."""
    return F.when(F.abs(z) <= l1, 0.0).otherwise(-(z - F.signum(z) * l1) / ((beta + F.sqrt(n)) / alpha + l2))


@dataclass(frozen=True)
class Rates:
    """alpha and beta set the steps; l1 is for one row and grows with the root of their number, as the noise of a sum of gradients does.

    The rows are dealt to batches, and these are gone through `passes` times.
    """

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.3
    l2: float = 0.1
    batches: int = 4
    passes: int = 5


def fit(sample: DataFrame, bits: int = 20, rates: Rates = Rates(), most_weights: int = 200_000) -> Weights:
    """Weights from rows (mark, batch, places), mark 0 or 1. The constant starts at the log-odds of the marks; it has no l1."""
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("mark"), F.lit(0))).first()
    if not n:
        return Weights(bits)
    w = Weights(bits, start := float(np.log((positive + 0.5) / (n - positive + 0.5))))
    state = None
    l1 = F.when(F.col("place") < 0, 0.0).otherwise(rates.l1 * n**0.5)
    own = weight(F.col("z"), F.col("n"), rates.alpha, rates.beta, l1, rates.l2)
    for step in range(rates.passes * rates.batches):
        told = _gradients(sample.filter(F.col("batch") == step % rates.batches), w).select("place", F.lit(0.0).alias("z"), F.lit(0.0).alias("n"), "g")
        known = told if state is None else told.unionByName(state.withColumn("g", F.lit(0.0)))
        summed = known.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("z", "n", "g")))
        squares = F.col("n") + F.col("g") * F.col("g")
        used = (F.sqrt(squares) - F.sqrt("n")) / rates.alpha * own
        before, state = state, materialize(summed.select("place", (F.col("z") + F.col("g") - used).alias("z"), squares.alias("n")), "coordinates")
        if before is not None:
            release(before)
        told = state.select("place", own.alias("w")).filter("w <> 0").limit(most_weights + 2).toArrow()
        if told.num_rows > most_weights + 1:
            raise RuntimeError(f"more than {most_weights} weights: raise l1 or most_weights")
        places, values = told["place"].to_numpy(), told["w"].to_numpy()
        w = Weights(bits, start + float(values[places < 0].sum()), places[places >= 0], values[places >= 0])
    release(state)
    return w


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, label_col: str, most_labelled: int, batches: int, bits: int) -> DataFrame:
    """(mark, batch, places) of the labelled documents that aren't held out: all of them, or about most_labelled chosen by a hash of their ids.

    A document that is marked both ways counts as marked 1; rows that repeat an id are all taken.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("mark")).filter("doc_id is not null and mark is not null")
    marks = marks.groupBy("doc_id").agg(F.max("mark").alias("mark")).filter(~held_out)
    n = marks.count()
    drawn = lambda salt, m: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(m))
    if n > most_labelled:
        marks = marks.filter(drawn(1, 1_000_000) < int(1_000_000 * most_labelled / n))
    rows = docs.join(marks, "doc_id").select("mark", drawn(2, batches).cast("int").alias("batch"), "text")

    def run(arrived):
        for batch in arrived:
            for start, end, data, offsets in chunks(_lower(batch.column(2))):
                keys = np.unique(np.concatenate([np.zeros(0, np.int64), *((row << bits) | place for row, place in terms(data, offsets, bits))]))
                ends = np.searchsorted(keys, np.arange(end - start + 1) << bits).astype(np.int32)
                places = pa.ListArray.from_arrays(ends, pa.array((keys & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, end - start) for i in (0, 1)), places], ["mark", "batch", "places"])

    return materialize(rows.mapInArrow(run, "mark int, batch int, places array<int>"), "labelled", "batch")


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.7,
    most_labelled: int = 20_000,
    bits: int = 20,
    rates: Rates = Rates(),
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs.

    The model learns from at most about most_labelled labelled rows for which held_out (an expression over doc_id, by default crc32 of its
    text modulo 3 being 1) isn't true. Only the text enters a score. Null and empty texts have the score of a text without terms; a null
    doc_id isn't held out and has no label; without labels all scores are 0.5. Repeated rows are scored alike. Extra columns, also ones named like the
    results, are ignored.
    """
    out = F.coalesce((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1) if held_out is None else held_out, F.lit(False))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = labelled(own, labels, out, label_col, most_labelled, rates.batches, bits)
    w = fit(sample, bits, rates)
    release(sample)

    def run(batches):
        table = w.table()
        for batch in batches:
            for start, end, data, offsets in chunks(_lower(batch.column(2))):
                s = _sigmoid(w.margins(table, data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(start, end - start) for i in (0, 1)), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return own.select("doc_id", out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
