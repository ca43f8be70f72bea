"""Operator 10, substring dedup by seed and extend.

Seeds are winnowed anchors: of the word grams inside each window the one with the smallest hash. Equal windows
have equal anchors, so that no repeat is without a seed.

1. Documents are joined on anchors: one aggregation finds the anchors that several documents hold, one join gives each
   document those among its own.
2. From each of these seeds a document is extended both ways, over all windows that the seed stands for. Where the whole
   extension is that of an earlier document, all its windows are repeats. Of each extension the first document is left;
   where extensions of one seed differ, those are compared window by window. Equal means equal hashes (64 bits each) of the
   seed's words and of all words of the extension or window.
3. The windows that an earlier document holds too are repeats, and adjoining ones merge into maximal repeats, none shorter than a window.

Aggregations combine before they shuffle, and joins have one row for each key on one side, so that a passage or phrase
that a third of all documents hold is never gathered in one group. Texts move twice, in 2 and in 3.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.kernels import U64, Words, chunks, range_hashes
from mapweave.runtime import materialize, release

#: A row of documents; the hash of its text tells rows of one id apart.
KEY = ["doc_id", "text_key"]


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on; the last n - 1 places see fewer."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out, np.concatenate([out[step:], np.full(min(step, len(out)), np.iinfo(U64).max, U64)])[: len(out)])
        have += step
    return out


def windows(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, hash of its words) of every window of the chunk's rows."""
    hashes = words.hashes()
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.repeat(words.bounds[1:], np.diff(words.bounds))
    first = np.flatnonzero(np.arange(len(hashes)) + window <= end)
    least = _least(words.grams(anchor, hashes), window - anchor + 1)
    return first, least[first].view(np.int64), words.grams(window, hashes)[first].view(np.int64)


def _rows_of(words: Words, first: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.bounds, first, "right") - 1


def seeds(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, text_key, anchors): the anchors of each row, without those next to themselves."""

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets, lower=False)
                first, anchors, _ = windows(words, window, anchor)
                row = _rows_of(words, first)
                new = np.ones(len(row), bool)
                new[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
                bounds = np.searchsorted(row[new], np.arange(end - start + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(anchors[new]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), lists], [*KEY, "anchors"])

    return texts.mapInArrow(run, "doc_id long, text_key long, anchors array<long>").filter(F.size("anchors") > 0)


def extensions(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, text_key, at, anchor, span, prints) for each run of windows of texts (with the column anchors) that share an anchor among those.

    span is the hash of all words of the run, prints are those of its windows.
    """
    names = [*KEY, "at", "anchor", "span", "prints"]

    def run(batches):
        for batch in batches:
            for start, end, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets, lower=False)
                first, anchors, prints = windows(words, window, anchor)
                row = _rows_of(words, first)
                edges = np.searchsorted(row, np.arange(end - start + 1))
                kept = [np.zeros(0, np.int64)]
                for r in range(end - start):
                    a, b = edges[r], edges[r + 1]
                    if b > a:
                        own = batch.column(3)[start + r].values.to_numpy(zero_copy_only=False)
                        kept.append(a + np.flatnonzero(np.isin(anchors[a:b], own)))
                take = np.concatenate(kept)
                new = np.ones(len(take), bool)
                new[1:] = (np.diff(take) != 1) | (anchors[take][1:] != anchors[take][:-1]) | (row[take][1:] != row[take][:-1])
                heads = np.flatnonzero(new)
                bounds = np.append(heads, len(take))
                head, last = take[heads], take[bounds[1:] - 1]
                spans = range_hashes(words.hashes(), first[head], first[last] + window).view(np.int64)
                rows = pa.array(start + row[head])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array((first[head] - words.bounds[row[head]]).astype(np.int32)),
                        pa.array(anchors[head]),
                        pa.array(spans),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(prints[take])),
                    ],
                    names,
                )

    return texts.mapInArrow(run, "doc_id long, text_key long, at int, anchor long, span long, prints array<long>")


def repeated_windows(texts: DataFrame, window: int = 13, anchor: int = 5) -> DataFrame:
    """(doc_id, text_key, places): runs (at, n) of windows of a row of (doc_id, text_key, text) whose words also stand in a row with a smaller id."""
    named = texts.filter("doc_id is not null")
    own = materialize(seeds(named, window, anchor), "seeds")
    each = own.select(*KEY, F.explode(F.array_distinct("anchors")).alias("anchor"))
    #: A written table on the side with one row a key leaves Spark free to split the hot keys of the other side.
    shared = materialize(each.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor"), "shared")
    seeded = materialize(each.join(shared, "anchor").groupBy(*KEY).agg(F.collect_set("anchor").alias("anchors")), "seeded")
    release(own, shared)
    found = materialize(extensions(named.join(seeded, KEY).select(*KEY, "text", "anchors"), window, anchor), "extensions")
    release(seeded)

    firsts = materialize(found.groupBy("anchor", "span").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "firsts")
    differ = firsts.groupBy("anchor").agg(F.min("low").alias("x"), F.max("low").alias("y")).filter("x < y").select("anchor", F.lit(True).alias("differ"))
    marks = firsts.join(differ, "anchor", "left").withColumn("differ", F.coalesce("differ", F.lit(False))).filter("low < high or differ")
    placed = found.join(marks, ["anchor", "span"]).filter("doc_id > low or differ").select(*KEY, "at", F.size("prints").alias("n"), "anchor", F.when(F.col("doc_id") == F.col("low"), F.col("prints")).alias("prints"))
    placed = materialize(placed, "placed")
    release(found, firsts)
    whole = placed.filter("prints is null").select(*KEY, "at", "n")
    single = placed.filter("prints is not null").select(*KEY, "at", "anchor", F.posexplode("prints").alias("i", "print"))
    lows = single.groupBy("anchor", "print").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor", "print", "low")
    lows = materialize(lows, "lows")
    later = single.join(lows, ["anchor", "print"]).filter("doc_id > low").select(*KEY, (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"))
    repeats = materialize(whole.unionByName(later).groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("places")), "repeats")
    release(placed, lows)
    return repeats


def covered(n_words: int, at: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Whether each word stands in one of the n windows from each of these places on."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + n - 1 + window, -1)
    return np.cumsum(step[:n_words]) > 0


def remove_repeats(
    docs: DataFrame, window: int = 13, anchor: int = 5, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, n_repeats, kept_sha256[, kept_text]) for each row of docs.

    A word goes when a window of `window` consecutive words that covers it also stands in a document with a smaller id.
    Windows are judged on the input. n_repeats counts the maximal runs of removed words; kept words are joined by
    one space. A null text has no words. Texts shorter than a window keep all. Rows that repeat an id don't
    remove each other's words; rows with a null id neither remove nor lose words. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    joined = own.join(repeated_windows(own, window, anchor), KEY, "left").select("doc_id", "text", F.col("places.at").alias("ats"), F.col("places.n").alias("ns"))
    names = ["doc_id", "n_words", "n_removed", "n_repeats", "kept_sha256"] + ["kept_text"] * with_text

    def row(text: str | None, ats: list[int] | None, ns: list[int] | None) -> tuple:
        data = (text or "").encode()
        parts = data.split()
        n, gone, repeats = len(parts), 0, 0
        if ats:
            out = covered(n, np.array(ats), np.array(ns), window)
            gone, repeats = int(out.sum()), int((np.diff(np.r_[0, out.astype(np.int8)]) == 1).sum())
            parts = [parts[i] for i in np.flatnonzero(~out)]
        kept = b" ".join(parts)
        return n, gone, repeats, hashlib.sha256(kept).hexdigest(), *([kept.decode()] * with_text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [row(*(x.as_py() for x in columns)) for columns in zip(*(part.column(i) for i in (1, 2, 3)), strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False))], names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, n_repeats long, kept_sha256 string" + ", kept_text string" * with_text)
