"""Operator 9, best-fit packing of tokenised documents into sequences.

Documents become token ids followed by an end id; longer ones are cut so that every piece but the first is
a whole sequence. Pieces are dealt at random to shards of bounded size, whose number follows the corpus, and each
shard packs its pieces in decreasing order: a bin has residual capacities for tokens, documents and attention
cost (the sum of squared lengths), and among the bins in which every residual suffices the piece goes to the
one with the least weighted residual norm, or with the largest weighted dot product of demand and residual.
A shard leaves few bins open, so that the total stays close to the least number possible.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.runtime import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
#: Letters, digits and signs of Western scripts and white space, for which both libraries split texts alike.
_PLAIN = re.compile("[^\t-\r -~\xa1-\u02af\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
#: Longest run without a space that the quick library takes; its time grows with the square of that.
_LONG = 2000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _quick(ranks: str, pattern: str):
    import base64

    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers.

    ranks may name a file with the same byte-level vocabulary as ranks, and pattern how it splits texts. Texts in plain characters,
    without special tokens or very long words, are then encoded by the library that reads such files: its ids are
    the same and it takes a quarter of the time.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        self.path, self.ranks, self.pattern = path, ranks, pattern
        added = _tokenizer(path).get_added_tokens_decoder().values()
        self.special = [x.content for x in added]

    def __call__(self, text: str) -> bytes:
        if self.ranks and not _PLAIN.search(text) and not any(x in text for x in self.special) and max(map(len, text.split(" "))) <= _LONG:
            return _quick(self.ranks, self.pattern).encode_to_numpy(text).astype("<u4").tobytes()
        return np.array(_tokenizer(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def byte_level(files, name: str = "byte_bpe_50k") -> dict[str, str]:
    """The arguments of best_fit for a vocabulary of a module with path() and PATTERN that comes in both forms."""
    return {"tokenizer": files.path(f"{name}.json"), "ranks": files.path(f"{name}.tiktoken"), "pattern": files.PATTERN}


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))] if length else []


def pieces(docs: DataFrame, encode: Encoder, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document. row tells rows of docs with equal ids apart within a task."""

    def run(batches):
        end, row = np.array([end_id], "<u4").tobytes(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for doc, text in zip(batch.column(0).slice(at, 1024).to_pylist(), batch.column(1).slice(at, 1024), strict=True):
                    ids = memoryview(encode(text.as_py() or "") + end)
                    for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                        out.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), row))
                    row += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], PIECES.replace(" long", "").replace(" int", "").split(", "))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def pack(lengths: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. capacities and weights are for tokens, documents and attention cost.

    A piece that doesn't fit an empty bin gets one of its own.
    """
    demand = np.column_stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / capacities
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((max(len(lengths), 1), 3))
    name = np.empty(max(len(lengths), 1), np.int64)
    used = np.zeros(max(len(lengths), 1), np.int64)
    is_open = total = 0
    least = demand.min(axis=0, initial=np.inf)
    for i in np.argsort(-lengths, kind="stable"):
        d = demand[i]
        at = -1
        if is_open:
            rest = left[:is_open] - d
            fits = np.flatnonzero(rest.min(axis=1) >= -1e-12)
            if len(fits):
                value = (rest[fits] ** 2) @ weights if rule == "norm" else -(left[fits] @ (weights * d))
                at = int(fits[np.argmin(value)])
        if at < 0:
            at, is_open = is_open, is_open + 1
            left[at], name[at], total = 1.0, total, total + 1
        bins[i], offsets[i] = name[at], used[name[at]]
        used[name[at]] += lengths[i]
        left[at] -= d
        if (left[at] < least - 1e-12).any():  # nothing fits any more
            is_open -= 1
            left[at], name[at] = left[is_open], name[is_open]
    return bins, offsets


def best_fit(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    rule: str = "norm",
    shard_pieces: int = 8192,
    end_id: int = 0,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    max_documents and max_attention bound the pieces and the sum of squared lengths of a sequence; unset, they
    are as large as the token capacity implies (capacity and capacity squared). ranks and pattern: see Encoder. A null or empty text is the end id alone.
    Rows with equal or null ids are packed as documents of their own. Extra columns are ignored.
    """
    capacities = np.array([capacity, max_documents or capacity, max_attention or float(capacity) ** 2])
    share = np.array(weights)
    cut = materialize(pieces(docs, Encoder(tokenizer, ranks, pattern), capacity, end_id, id_col, text_col), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def run(table: pa.Table) -> pa.Table:
        bins, offsets = pack(table["length"].to_numpy(), capacities, share, rule)
        shard = table["shard"].to_numpy()[0]
        kept = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array((int(shard) << 32) + bins)).append_column("offset", pa.array(offsets))

    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
