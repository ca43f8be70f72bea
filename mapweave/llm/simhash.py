"""Operator 6, document fingerprints: SimHash, and permuted block tables for all fingerprints within a Hamming radius.

DataFrame expressions only. The terms are shingles of five words, each weighted by how often it occurs; the hash of a
term votes on 64 bits, and a bit is set where more than half of the weight votes for it. The votes are counted
in 16 long integers with four 16-bit fields each, so that a term costs 16 additions.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.runtime import materialize

BITS = 64
_FIELDS = 0x0001000100010001
#: Terms whose votes fit into a 16-bit field.
_CHUNK = 32_767


def _terms(text: Column, shingle_words: int) -> Column:
    """Hashes of the shingles of a text; with fewer words than one takes, of all words together."""
    words = F.transform(F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w))

    def over(ws: Column) -> Column:
        n = F.size(ws)
        shingle = lambda i: F.xxhash64(*(F.element_at(ws, i + j) for j in range(shingle_words)))
        few = F.when(n > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<long>"))
        return F.when(n >= shingle_words, F.transform(F.sequence(F.lit(1), n - shingle_words + 1), shingle)).otherwise(few)

    return _let(words, over)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _votes(terms: Column) -> Column:
    """64 counts, of bit 0 first."""
    lanes = [f"l{j}" for j in range(16)]
    zero = F.struct(*(F.lit(0).cast("long").alias(x) for x in lanes))
    add = lambda acc, h: F.struct(*((acc[x] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_FIELDS))).alias(x) for j, x in enumerate(lanes)))
    # field f of lane j counts bit 16 * f + j
    unpacked = lambda acc: F.array(*(F.shiftrightunsigned(acc[f"l{b % 16}"], 16 * (b // 16)).bitwiseAND(F.lit(0xFFFF)) for b in range(BITS)))
    count = lambda part: F.aggregate(part, zero, add, unpacked)
    starts = F.sequence(F.lit(0), F.floor((F.size(terms) - 1) / _CHUNK).cast("int"))
    many = F.aggregate(
        F.transform(starts, lambda c: count(F.slice(terms, c * _CHUNK + 1, _CHUNK))),
        F.array_repeat(F.lit(0).cast("long"), BITS),
        lambda acc, part: F.zip_with(acc, part, lambda x, y: x + y),
    )
    return F.when(F.size(terms) <= _CHUNK, count(terms)).otherwise(many)


def fingerprint(text: Column, shingle_words: int = 5) -> Column:
    """The 64-bit SimHash of a text; 0 for a text without words."""

    def bits(terms: Column) -> Column:
        def packed(votes: Column) -> Column:
            set_bit = lambda acc, b: acc.bitwiseOR(F.when(F.element_at(votes, b + 1) * 2 > F.size(terms), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(0))
            return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), set_bit)

        return _let(_votes(terms), packed)

    return _let(_terms(text, shingle_words), bits)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


#: Rows that a range of ids should hold, and from how many times that a range is cut again.
RANGE_ROWS, HEAVY = 256, 16


def _cut(docs: DataFrame, cuts: list[tuple[float, DataFrame | None]]) -> DataFrame:
    """docs with c0, c1, ...: the numbers of an id's ranges, from the widest on. They follow the order of ids."""
    for k, (step, heavy) in enumerate(cuts):
        if heavy is None:
            docs = docs.withColumn("c0", F.coalesce(F.floor(F.col("doc_id").cast("double") / step), F.lit(-(1 << 62))))
        else:
            fine = F.coalesce(F.floor((F.col("doc_id") - F.col("start")) / F.col("step")), F.lit(0))
            docs = docs.join(heavy, [f"c{i}" for i in range(k)], "left").withColumn(f"c{k}", fine).drop("start", "step")
    return docs


def _cuts(ids: DataFrame, most: int = 12) -> list[tuple[float, DataFrame | None]]:
    """How to cut ids into ranges of about RANGE_ROWS rows, by ids alone.

    First all ids by one width; then, as long as some range holds HEAVY times as many (some ids lie far from the others), such ranges by their
    own span. A level's table has a row for each of these. Rows of one id stay together.
    """
    low, high, rows = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    cuts: list[tuple[float, DataFrame | None]] = [(max(1.0, (int(high or 0) - int(low or 0) + 1) * RANGE_ROWS / max(rows, 1)), None)]
    while len(cuts) < most:
        keys = [f"c{i}" for i in range(len(cuts))]
        held = _cut(ids, cuts).groupBy(*keys).agg(F.count("*").alias("n"), F.min("doc_id").alias("start"), F.max("doc_id").alias("end"))
        step = F.greatest(F.lit(1.0), (F.col("end") - F.col("start") + 1) * float(RANGE_ROWS) / F.col("n"))
        heavy = materialize(held.filter(f"n > {HEAVY * RANGE_ROWS} and start < end").select(*keys, "start", step.alias("step")), "heavy")
        if heavy.isEmpty():
            break
        cuts.append((0.0, heavy))
    return cuts


def _ranged(docs: DataFrame, cuts: list[tuple[float, DataFrame | None]]) -> DataFrame:
    """docs with place, range and group; ranges follow the order of ids, and groups of ranges that of ranges. Null ids come last, in a range of their own."""
    names = [f"c{i}" for i in range(len(cuts))]
    out = _cut(docs, cuts).withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    return out.withColumn("range", F.struct(*names)).withColumn("group", F.struct(*(F.floor(F.col(c) / 4096).alias(c) for c in names))).drop(*names)


def _with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs with next_<column>: the row with the next smaller doc_id (for the smallest, the largest).

    Rows are ordered inside ranges of ids. The last row of each range is also sent to the next range, so that texts
    are shuffled once; which rows these are is found beforehand from the ids alone. Null ids come last; rows with
    equal ids are ordered by their text.
    """
    columns = docs.columns
    cuts = _cuts(docs.select("doc_id"))
    ranges = _ranged(docs.select("doc_id"), cuts)
    tails = ranges.groupBy("range", "group").agg(F.max("place").alias("place"))
    tails = tails.withColumn("next", F.lead("range").over(Window.partitionBy("group").orderBy("range")))
    #: One row for about a million documents; the last range leads to the first.
    groups = tails.groupBy("group").agg(F.min("range").alias("first"))
    whole = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("group", F.coalesce(F.lead("first").over(Window.orderBy("group")), F.min("first").over(whole)).alias("wrap"))
    tails = materialize(tails.join(groups, "group").select("range", "place", F.coalesce("next", "wrap").alias("next")), "tails")

    sent = _ranged(docs, cuts).join(tails, ["range", "place"], "left")
    both = F.filter(F.array(F.struct(F.col("range").alias("r"), F.lit(1).alias("own")), F.struct(F.col("next").alias("r"), F.lit(0).alias("own"))), lambda x: x["r"].isNotNull())
    sent = sent.select(*columns, "place", F.explode(both).alias("to")).select(*columns, "place", "to.r", "to.own")
    inside = Window.partitionBy("r").orderBy("own", "place", "text")
    found = sent.select(*columns, "own", *(F.lag(c).over(inside).alias(f"next_{c}") for c in carried))
    return found.filter("own = 1").drop("own")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b, distance): for each distinct fingerprint a of queries all distinct ones b of index within the radius.

    Two fingerprints that differ in at most `radius` bits agree in `blocks - radius` of the blocks at least. Each choice of
    so many blocks is a table, keyed by their bits; a pair is taken from the first table in which it meets. Null
    fingerprints are left out.
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be below the number of blocks")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(reduce(int.__or__, (((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen))) for chosen in combinations(range(blocks), blocks - radius)]
    keys = F.array(*(F.struct(F.lit(t).alias("table"), F.col("f").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(tables)))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col(rows.columns[0]).alias("f")).filter("f is not null").distinct()
        return rows.select(F.col("f").alias(name), F.explode(keys).alias("k")).select(name, "k.table", "k.key")

    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(t)) for t, m in enumerate(tables)))
    met = keyed(queries, "a").join(keyed(index, "b"), ["table", "key"])
    return met.filter((F.bit_count(differ) <= radius) & (F.col("table") == first)).select("a", "b", F.bit_count(differ).alias("distance"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, f, next_f, edited_f): fingerprints of each row, the next one and the edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document. A null text counts as empty; a text without words has the fingerprint 0. Extra columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("f", fingerprint(F.col("text")))
    both = _with_next(own, "text", "f")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "f", "next_f")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "next_f", fingerprint(F.col("edited")).alias("edited_f")
    )


def digest(docs: DataFrame, radius: int = 3, every: int = 20) -> DataFrame:
    """fingerprints() as text with likenesses.

    n_within counts the other rows whose fingerprint lies within the radius, for rows whose id is divisible by `every` (null
    for the others).
    """
    found = materialize(fingerprints(docs), "fingerprints")
    weights = found.groupBy(F.col("f").alias("b")).agg(F.count("*").alias("rows"))
    asked = found.filter(F.col("doc_id") % every == 0)
    pairs = within_radius(asked.select("f"), found.select("f"), radius)
    within = pairs.join(weights, "b").groupBy("a").agg((F.sum("rows") - 1).alias("n_within")).withColumnRenamed("a", "f")
    return found.join(within, "f", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexadecimal(F.col("f")).alias("fingerprint"),
        hexadecimal(F.col("edited_f")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("edited_f")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n_within")).alias("n_within"),
    )
