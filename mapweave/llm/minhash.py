"""Operator 1, MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

Every document becomes the set of its distinct word shingles (64-bit hashes of one hash function). Its sketch is
the k smallest of them. Documents with equal sets form a class and only the classes are compared:

1. Inverted lists hold the classes by runs of retained values: r consecutive values of the sorted sketch are a
   key. Similar sets differ in few values, so that several runs are the same on both sides (`least_runs`), while
   a passage or a frequent word pair that unrelated texts share is seldom unbroken by their other values. As that
   many runs are shared, each class leaves out its most frequent ones but for one fewer.
2. In each list every class is held against one hub, the most central class of the list, so a group of near
   copies takes as many comparisons as it has members. The union-sketch estimate sorts out pairs that are far apart,
   the full sets decide on the others.
3. Classes that nearness to hubs joins are a family, and are held against the family's most central class. Two classes near
   the same centre are as far apart as their differences from it say. Where one of them isn't linked to the
   centre, a link takes more than half of the other's difference in common: a prefix of the rarest part of
   each difference finds these pairs without going through all pairs of the group.
4. Classes far from the hub of a list can only be similar to others far from it. These form one pool, in which a similar pair has
   one of the rarest fifth of its shingles in common: lists of those, however alike the rest of a template makes the texts.
5. The pairs of 3 and 4 pass the union-sketch estimate (`least_hits`) before their full sets decide.

Texts are read twice, for sketches and for the sets of classes that a list joins, which are written once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.llm.kernels import U64, Words, chunks, mix, range_hashes
from mapweave.operators.graph import connected_components
from mapweave.runtime import materialize, release

SKETCH = "doc_id long, n_shingles long, set_key binary, sketch array<long>"
SETS = "node long, shingles array<long>"
#: Jaccard similarity to a hub, in percent. A class below FAR is only compared with others below FAR; a sketch estimate
#: under UNLIKELY leaves no doubt that the similarity is below NEAR; and two similar classes lie on either side of FAR
#: only where both are above NEAR (distances obey the triangle inequality, so FAR is NEAR plus 20 for 80).
UNLIKELY, NEAR, FAR = 20, 45, 65
#: An estimate is off by less but for a chance of 1e-6, and one over FAR + DOUBT shows that a class isn't far.
DOUBT = 25


def _shingles(column: pa.Array, words: int):
    """For each row its sorted distinct shingle hashes, as signed 64-bit integers."""
    for _, _, data, offsets in chunks(column):
        found = Words(data, offsets, lower=True)
        hashes = found.hashes()
        grams = found.grams(words, hashes).view(np.int64)
        for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            else:
                few = np.arange(a, min(b, a + 1))  # the whole sequence as one, or nothing
                yield range_hashes(hashes, few, np.full(len(few), b)).view(np.int64)


def _set_key(shingles: np.ndarray) -> bytes | None:
    """A 128-bit key of the set."""
    if not len(shingles):
        return None
    own = shingles.view(U64)
    with np.errstate(over="ignore"):
        return np.array([mix(own + U64(1)).sum(), mix(own ^ U64(0xA5A5A5A5A5A5A5A5)).sum() + U64(len(own))], ">u8").tobytes()


def sketches(docs: DataFrame, shingle_words: int = 5, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) for each row. set_key names the shingle set, null when that is empty."""

    def run(batches):
        for batch in batches:
            sets = list(_shingles(batch.column(1), shingle_words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_key(s) for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) with the whole set of each row of (doc_id, text)."""

    def run(batches):
        for batch in batches:
            sets = pa.array(list(_shingles(batch.column(1), shingle_words)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["node", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def run_length(k: int, percent: int, most: int = 3) -> int:
    """Longest runs, up to `most`, of which similar sets share some for sure (but for a chance of one in 10**9)."""
    return max([1, *(r for r in range(1, most + 1) if least_runs(k, r, percent))])


def least_runs(k: int, r: int, percent: int, miss: float = 1e-9) -> int:
    """Runs of r that a pair of that similarity shares at least among k union values, but for a chance of miss."""
    p = percent / 100
    state = {(0, 0): 1.0}  # shared runs so far, length of the current one
    for _ in range(k):
        after: dict[tuple[int, int], float] = {}
        for (runs, length), chance in state.items():
            longer = min(length + 1, r)
            for key, q in (((runs, 0), 1 - p), ((runs + (longer == r), longer), p)):
                after[key] = after.get(key, 0.0) + chance * q
        state = after
    tail, runs = 0.0, 0
    while runs < k and (tail := tail + sum(q for (n, _), q in state.items() if n == runs)) <= miss:
        runs += 1
    return runs


def small_sets(k: int, r: int, percent: int) -> dict[int, tuple[list[int], int]]:
    """For sets that are sketched whole with all that is similar: run lengths to keep, and shared runs of r at least.

    Of a union of u values d at most aren't shared; they split the others into d + 1 runs.
    """
    out = {}
    for n in range(1, k * percent // 100 + 1):
        lengths, least = {r}, k
        for union in range(n, n * 100 // percent + 1):
            differ = union - -(-union * percent // 100)
            if differ:
                lengths.add(min(r, -(-(union - differ) // (differ + 1))))
                least = min(least, max(0, union - differ - (r - 1) * (differ + 1)))
        out[n] = (sorted(lengths), least)
    return out


def inverted_lists(classes: DataFrame, k: int, r: int, percent: int) -> DataFrame:
    """(value, node, score), written: classes by runs of retained values; score tells how central a class is."""
    small = small_sets(k, r, percent)

    def keys(length: int) -> Column:
        places = F.sequence(F.lit(1), F.size("sketch") - length + 1)
        run = lambda i: F.xxhash64(F.lit(length), *(F.element_at("sketch", i + j) for j in range(length)))
        return F.when(F.size("sketch") >= length, F.transform(places, run)).otherwise(F.array().cast("array<long>"))

    runs = keys(r)
    for n, (lengths, _) in small.items():
        if lengths != [r]:
            runs = F.when(F.col("n") == n, F.concat(*(keys(x) for x in lengths))).otherwise(runs)
    general = least_runs(k, r, percent)
    least = F.array(*(F.lit(0 if lengths != [r] else min(x, general)) for lengths, x in small.values()))
    left_out = F.greatest(F.lit(0), F.when(F.col("n") <= len(small), F.element_at(least, F.least("n", F.lit(len(small))).cast("int"))).otherwise(general) - 1)

    postings = classes.select("node", F.col("n_shingles").alias("n"), "sketch").select("node", "n", F.explode(F.array_distinct(runs)).alias("value"))
    #: Written, so that Spark can split the postings of a hot value among tasks.
    often = materialize(postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    by_node = Window.partitionBy("node", "n")
    lists = (
        postings.join(often, "value")
        .withColumn("place", F.row_number().over(by_node.orderBy(F.desc("df"), "value")))
        .withColumn("score", F.sum("df").over(by_node))
        .filter(F.col("place") > left_out)
        .select("value", "node", "score")
    )
    lists = materialize(lists, "lists")
    release(often)
    return lists


def _sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def least_hits(k: int, percent: int) -> Column:
    """Values of the union sketch u that a pair of that similarity shares at least: all it takes of a whole union, of k but for a chance of 1e-9."""
    return F.when(F.size("u") < k, F.size("u") * percent / 100).otherwise(least_runs(k, 1, percent))


def _with_estimate(both: DataFrame, k: int) -> DataFrame:
    """Pairs with sketches s_a and s_b, their union sketch u, and hits, the values of u that both have."""
    both = both.withColumn("u", F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k))
    return both.withColumn("hits", F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), "u")))


def _estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(a, b, estimate): the similarity that the union sketch of each pair shows."""
    sides = [classes.select(F.col("node").alias(x), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
    both = _with_estimate(pairs.join(sides[0], "a").join(sides[1], "b"), k)
    return both.groupBy("a", "b").agg(F.max(F.col("hits") / F.size("u")).alias("estimate"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with their full sets, sizes and intersection size."""
    sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}"), F.size("shingles").alias(f"n_{x}")) for x in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", "set_a", "set_b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("both"))


def _estimated_then_compared(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """As _compared, for the pairs whose union sketch, the least k values of both sets, leaves the similarity possible."""
    sides = [sets.select(F.col("node").alias(x), F.slice("shingles", 1, k).alias(f"s_{x}")) for x in "ab"]
    likely = _with_estimate(pairs.join(sides[0], "a").join(sides[1], "b"), k).filter(F.col("hits") >= least_hits(k, percent))
    return _compared(materialize(likely.select("a", "b").distinct(), "pairs"), sets)


def _near_hubs(held: DataFrame, seen: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components near one hub whose differences from it leave the link possible.

    held has hub, node, n, n_hub, linked, difference and asked; one of a pair is asked for. With |D| the size of a difference, two classes x, y are
    |Dx| + |Dy| - 2 |Dx and Dy| apart; a link allows `apart` of |x| + |y|.
    """
    apart = (100 - percent) / (100 + percent)
    placed = held.join(seen, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("hub").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("hub")
    placed = placed.join(mixed, "hub").withColumn("size", F.size("difference"))
    elements = placed.select("hub", "node", "n", "n_hub", "component", "linked", "asked", "size", F.explode("difference").alias("value"))
    often = elements.groupBy("hub", "value").agg(F.count("*").alias("df")).filter("df > 1")
    #: x isn't linked to the hub, so |Dx| > apart * (|x| + |hub|); and |Dx| >= |Dy| - apart * (|x| + |y|).
    half = (F.col("size") - F.greatest(F.lit(0), F.col("n") - F.col("n_hub")) * apart) / 2
    whole = F.col("size") - F.col("n") * (apart * (1 + 100 / percent))
    least = F.greatest(F.lit(1), F.ceil(F.greatest(half, whole) - 1e-9))
    by_node = Window.partitionBy("hub", "node", "n")
    ranked = (
        elements.join(often, ["hub", "value"])
        .withColumn("place", F.row_number().over(by_node.orderBy("df", "value")))
        .withColumn("after", F.count("*").over(by_node) - F.col("place"))
    )
    index = ranked.filter(F.col("after") >= least - 1)
    left = ranked.filter("not linked").select("hub", "value", *(F.col(c).alias(f"{c}_x") for c in ("node", "n", "component", "size", "asked", "after")))
    right = index.select("hub", "value", *(F.col(c).alias(f"{c}_y") for c in ("node", "n", "component", "size", "asked", "after")))
    close = F.abs(F.col("size_x") - F.col("size_y")) <= (F.col("n_x") + F.col("n_y")) * apart
    #: The first common element has all others after it, on both sides.
    close &= 2 * (1 + F.least("after_x", "after_y")) >= F.col("size_x") + F.col("size_y") - (F.col("n_x") + F.col("n_y")) * apart - 1e-9
    pairs = left.join(right, ["hub", "value"]).filter((F.col("component_x") != F.col("component_y")) & _sizes_fit("n_x", "n_y", percent) & close & (F.col("asked_x") | F.col("asked_y")))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def _not_near(lists: DataFrame, hubs: DataFrame, spokes: DataFrame) -> DataFrame:
    """(value, hub, node) of the classes whose estimate leaves it open that they are far from a list's hub, where there are several of them."""
    far = lists.join(hubs, "value").join(spokes.select(F.col("a").alias("hub"), F.col("b").alias("node"), "estimate"), ["hub", "node"])
    far = far.filter(F.col("estimate") < (FAR + DOUBT) / 100).select("value", "hub", "node")
    several = far.groupBy("value").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("value")
    return far.join(several, "value")


def _far_pool(doubtful: DataFrame, held: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, component) of the classes far from the hub of a list that holds such classes of several components."""
    known = held.select("hub", "node", F.col("similar").alias("to_hub"))
    far = doubtful.join(known, ["hub", "node"], "left").filter(F.coalesce("to_hub", F.lit(0)) < FAR / 100)
    placed = far.select("value", "node").join(seen, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("value")
    return placed.join(split, "value").select("node", "component").distinct()


def _within_pool(pool: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of the pool in different components that may be similar: the first common shingle, from the rarest on, has all others after it on both sides."""
    elements = sets.join(pool, "node").select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    often = elements.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    by_node = Window.partitionBy("node", "n")
    ranked = (
        elements.join(often, "value")
        .withColumn("place", F.row_number().over(by_node.orderBy("df", "value")))
        .withColumn("after", F.count("*").over(by_node) - F.col("place"))
        .filter((F.col("after") + 1) * 100 >= F.col("n") * percent)
    )
    left, right = (ranked.select("value", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "after"))) for x in "ab")
    across = (F.col("component_a") != F.col("component_b")) & (F.col("node_a") < F.col("node_b")) & _sizes_fit("n_a", "n_b", percent)
    enough = (F.least("after_a", "after_b") + 1) * 100 >= F.greatest("n_a", "n_b") * percent
    return left.join(right, "value").filter(across & enough).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _joined_further(seen: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) of the components seen after links more (a, b): only components that these join go through another search."""
    if more.isEmpty():
        return seen
    ends = [seen.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab"]
    over = more.join(ends[0], "a", "left").join(ends[1], "b", "left")
    tops = connected_components(over.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")), "a", "b")
    moved = seen.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return moved.select("node", F.coalesce("top", "component").alias("component")).unionByName(tops.join(seen, "node", "left_anti").select("node", "component"))


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    k: int = 96,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest id reachable by links. A text with fewer words than a shingle is one shingle; a null text or one without
    words has an empty set, is linked with nothing and is its own component. Rows with equal ids are one vertex,
    linked wherever one of them is. A row with a null id can't be named: it is linked with nothing, has
    a null component and is kept. Extra columns are ignored. percent is 80 or more (see FAR).
    """
    if percent < 80:
        raise ValueError("similarities below 80 percent need other bounds")
    r = run_length(k, percent)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = materialize(sketches(texts, shingle_words, k), "sketches")
    named = own.filter("set_key is not null and doc_id is not null")
    labels = materialize(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "labels")
    first_rows = (named["set_key"] == labels["set_key"]) & (named["doc_id"] == labels["node"])
    classes = named.join(labels, first_rows, "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
    lists = inverted_lists(classes, k, r, percent)
    linked = F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent
    similar = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))

    hubs = materialize(lists.groupBy("value").agg(F.max_by("node", F.struct("score", "node")).alias("hub")), "hubs")
    spokes = lists.join(hubs, "value").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    estimates = materialize(_estimated(spokes, classes, k), "spokes")
    likely = estimates.filter(F.col("estimate") >= UNLIKELY / 100).select("a", "b")
    doubtful = materialize(_not_near(lists, hubs, estimates), "doubtful")
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).unionByName(doubtful.select("node")).distinct()
    #: The plan is the same whether they are few or many: each text moves once.
    texts_of = texts.join(nodes.select(F.col("node").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = materialize(full_sets(texts_of, shingle_words).filter(F.size("shingles") > 0), "sets")
    difference = F.concat(F.array_except("set_a", "set_b"), F.array_except("set_b", "set_a"))

    def against(pairs: DataFrame, name: str) -> DataFrame:
        found = _compared(pairs, sets).select(
            F.col("a").alias("hub"), F.col("b").alias("node"), F.col("n_a").alias("n_hub"), F.col("n_b").alias("n"), linked.alias("linked"), similar.alias("similar"),
            F.when(similar >= NEAR / 100, difference).alias("difference"),
        )
        return materialize(found, name)

    held = against(likely, "held")
    near = held.filter("difference is not null")
    families = materialize(connected_components(near, "hub", "node"), "families")
    scores = lists.groupBy("node").agg(F.max("score").alias("score"))
    centres = families.join(scores, "node").groupBy("component").agg(F.max_by("node", F.struct("score", "node")).alias("a"))
    release(hubs)
    members = families.join(centres, "component").filter("a <> node").select("a", F.col("node").alias("b"))
    centred = against(members, "centred")
    seen = materialize(connected_components(held.unionByName(centred).filter("linked"), "hub", "node"), "seen")
    inside = centred.filter("difference is not null").withColumn("asked", F.lit(True))
    #: A class far from its family's centre keeps its place at the hubs that it is near to.
    outside = near.join(centred.filter("difference is null").select("node").distinct(), "node", "left_semi").select("hub", "node").withColumn("asked", F.lit(True))
    rest = near.join(outside.select("hub").distinct(), "hub", "left_semi").join(outside, ["hub", "node"], "left")
    rest = rest.withColumn("asked", F.coalesce("asked", F.lit(False)))

    pool = materialize(_far_pool(doubtful, held, seen), "pool")
    pairs = _near_hubs(inside, seen, percent).unionByName(_near_hubs(rest, seen, percent)).unionByName(_within_pool(pool, sets, percent)).distinct()
    second = materialize(_estimated_then_compared(materialize(pairs, "proposed"), sets, k, percent).filter(linked).select("a", "b"), "second")
    release(sets, doubtful, pool)

    found = named.select("doc_id", "set_key").join(labels, "set_key").filter("doc_id <> node").select("doc_id", "node").distinct()
    #: Rows with equal ids are one vertex, so copies are edges too where an id has more than one set.
    more = second
    twice = named.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y").select("doc_id")
    if not twice.isEmpty():
        more = more.unionByName(found.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    places = _joined_further(seen, more)
    release(estimates, held, centred, families, second)
    out = own.join(labels, "set_key", "left").join(places, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
