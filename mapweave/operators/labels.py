"""Label scores and label choice per country.

Tables are long: labels(article_id, label), countries(article_id, country). NULL keys are dropped, as grouping by
them has no meaning here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from mapweave.functions.text import with_word_forms
from mapweave.operators.quantiles import quantiles
from mapweave.operators.ranks import best, numbered
from mapweave.runtime import materialize


def label_counts(labels: DataFrame, countries: DataFrame) -> DataFrame:
    """One row for each (country, label): the counts that the scores need (A1-A5).

    clc rows of the label in the country, ncl rows of the country, lcp rows of the label, n_country_articles and n_articles
    distinct articles. One aggregation by country and label; the others run over its result.
    """
    rows = labels.filter("label is not null").join(countries.filter("country is not null"), "article_id")
    return _counts(rows.groupBy("country", "label").agg(F.count("*").alias("clc")), rows.select("country", "article_id").distinct())


def listed_counts(lists: DataFrame) -> DataFrame:
    """label_counts() of (article_id, country, labels): each article's labels in one list, which no shuffle takes apart before they are counted.

    The lists and the counts by country and label are written once, as the counts' readers would make them anew.
    """
    lists = materialize(lists.select("article_id", "country", "labels").filter("article_id is not null and country is not null and size(labels) > 0"), "lists", collect=False)
    base = lists.select("country", F.explode("labels").alias("label")).filter("label is not null").groupBy("country", "label").agg(F.count("*").alias("clc"))
    base = materialize(base, "counts", collect=False)
    some = lists.filter(F.exists("labels", lambda x: x.isNotNull())).select("country", "article_id").distinct()
    return _counts(base, some)


def _counts(base: DataFrame, members: DataFrame) -> DataFrame:
    """What label_counts() adds to base (country, label, clc) and members, the distinct (country, article_id)."""
    by_country = base.groupBy("country").agg(F.sum("clc").alias("ncl"))
    by_label = base.groupBy("label").agg(F.sum("clc").alias("lcp"))
    per_country = members.groupBy("country").agg(F.count("*").alias("n_country_articles")).join(by_country, "country")
    total = members.select("article_id").distinct().agg(F.count("*").alias("n_articles"))
    labels_total = by_label.agg(F.count("*").alias("n_labels"))
    one_row = F.broadcast(total.crossJoin(F.broadcast(labels_total)))  # one row, whatever the data
    return base.join(by_label, "label").join(per_country, "country").crossJoin(one_row)


def exact_sum(value: str) -> Column:
    """The sum of doubles, the same in whatever order they come, so that equal sums tie: as decimals of 18 places where all of a group are such."""
    exact = F.col(value).try_cast("decimal(38,18)")
    whole = F.count(exact) == F.count(F.col(value))
    return F.when(whole, F.coalesce(F.try_sum(exact).cast("double"), F.sum(value))).otherwise(F.sum(value))


def summed_in_order(rows: DataFrame, group: str, value: str, order: str, name: str = "total") -> DataFrame:
    """(group, name): doubles added one after another by `order` (ties: the smaller value first), as a single scan adds them, rounding included. Null groups and values are left out.

    Sums follow the sorted rows of a task, so no group is held whole; one group is added up by one task, as each step needs the one before.
    """

    def run(batches):
        last, total = None, 0.0
        for batch in batches:
            keys, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            done: list[tuple] = []
            for at, end in zip(starts, np.append(starts[1:], len(keys)), strict=False):
                if last is None or keys[at] != last:
                    done += [] if last is None else [(last, total)]
                    last, total = keys[at], 0.0
                total = np.add.accumulate(np.append(total, x[at:end]))[-1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([t for _, t in done], pa.float64())], [group, name])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([total], pa.float64())], [group, name])

    there = rows.select(group, F.col(value).cast("double").alias("__x"), order).filter(F.col(group).isNotNull() & F.col("__x").isNotNull())
    kind = to_arrow_type(there.schema[group].dataType)
    sorted_rows = there.repartition(group).sortWithinPartitions(group, order, "__x").select(group, "__x")
    return sorted_rows.mapInArrow(run, f"{group} {there.schema[group].dataType.simpleString()}, {name} double")


def rows_per(rows: DataFrame, key: str, name: str = "label_count") -> DataFrame:
    """rows with the number of rows that have the same key, null keys dropped."""
    return rows.join(rows.groupBy(key).agg(F.count("*").alias(name)), key)


def members(rows: DataFrame, group: str, value: str, pad_to: int = 0) -> DataFrame:
    """(group, values): the distinct values of each group in order, padded by empty strings to that length.

    For values that are few in a group, as categories and candidate labels are.
    """
    values = F.array_sort(F.collect_set(F.col(value).cast("string")))
    padded = F.concat("values", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(pad_to) - F.size("values"))))
    return rows.groupBy(group).agg(values.alias("values")).withColumn("values", padded)


def tf_idf() -> Column:
    return F.col("clc") / F.col("ncl") * F.log(F.col("n_articles") / (F.col("lcp") + 10))


def tf_idf_smoothed() -> Column:
    return F.col("clc") / (F.col("ncl") + 1) * F.log(F.col("n_articles") / (F.col("lcp") + 10))


def pmi() -> Column:
    return F.col("clc") / (F.col("ncl") + 1) * F.col("n_articles") / (F.col("lcp") + F.lit(0.25) * F.col("n_country_articles"))


def hierarchy_score(scored: DataFrame, by_normalised: bool = False) -> DataFrame:
    """Score of category labels (A9, A9b, W1): tf * ln(labels / (6 * lcp)) * the country's share of tfidf.

    With by_normalised the last factor is the tfidf scaled to 0..1 within the country.
    """
    ends = scored.groupBy("country").agg(F.min("tfidf").alias("__low"), F.max("tfidf").alias("__high"))
    scaled = F.coalesce((F.col("tfidf") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0.0)), F.lit(0.0))
    idf = F.log(F.col("n_labels") / (F.lit(6.0) * F.col("lcp")))
    rows = scored.join(ends, "country").withColumn("scaled", scaled).drop("__low", "__high")
    return rows.withColumn("score", F.col("clc") / F.col("ncl") * idf * F.col("scaled" if by_normalised else "tfidf"))


def top_per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def exclusive_top_n(scored: DataFrame, n: int, blacklist: list[str] | None = None, max_rounds: int = 1000, distinct_stems: bool = False) -> DataFrame:
    """(country, label, score): at most n labels for a country, each label in one country only.

    With distinct_stems that also holds for labels of equal stems (T3, T4): of those in one country only the best can be chosen.

    Same as going through all (country, label) rows by falling score (ties: label, country) and giving a label to the
    first country that still has room. Done by deferred acceptance: in each round every label proposes to its
    best country that hasn't rejected it, and every country keeps its best n; both sides order by the same score. What a
    country keeps only gets better, so its n-th best proposal is a threshold: rows behind it, proposed or not, are dropped for good,
    and rounds end when no proposal lies behind one. Thresholds come from the best n of parts of a country.
    """
    rows = scored.select("country", "label", "score").filter("country is not null and label is not null and score is not null")
    rows = rows.groupBy("country", "label").agg(F.max("score").alias("score"))
    if blacklist:
        rows = rows.filter(~F.col("label").isin(blacklist))
    if distinct_stems:
        stems = with_word_forms(rows.select("label").distinct())
        top = rows.join(stems, "label").groupBy("country", "stem").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("b"))
        own = top.select("country", F.col("stem"), F.col("b.label").alias("own"), -F.col("b.s"))
        chosen = exclusive_top_n(own.toDF("country", "label", "own", "score"), n, None, max_rounds)
        return chosen.withColumnRenamed("label", "stem").join(own.select("country", "stem", F.col("own").alias("label")), ["country", "stem"]).select("country", "label", "score")
    choice = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "country"))  # one row a country
    for _ in range(max_rounds):
        proposed = materialize(rows.withColumn("choice", choice), "proposals", collect=False)
        first = proposed.filter("choice = 1").select("country", "label", "score")
        last = best(first, "country", n, F.desc("score"), F.asc("label")).filter(F.col("place") == n).select("country", F.col("score").alias("__s"), F.col("label").alias("__l"))
        full = materialize(last, "thresholds", collect=False)  # one row a country
        beyond = F.coalesce((F.col("score") < F.col("__s")) | ((F.col("score") == F.col("__s")) & (F.col("label") > F.col("__l"))), F.lit(False))
        judged = proposed.join(full, "country", "left").withColumn("rejected", beyond)
        if judged.filter("rejected and choice = 1").isEmpty():
            return first
        rows = judged.filter("not rejected").select("country", "label", "score")
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def average_rank(rows: DataFrame, group: str, value: str) -> DataFrame:
    """min_rank and avg_rank of value within the group, largest first (W2). Nulls rank last, equal to each other.

    Ranks are found for the distinct values of a group with the number of their rows, and joined to the rows.
    """
    counted = rows.groupBy(F.col(group).alias("__g"), F.col(value).alias("__v")).agg(F.count("*").alias("__ties"))
    placed = numbered(counted, "__g", [F.desc("__v")], "min_rank", F.col("__ties"))
    joined = rows.join(placed, F.col(group).eqNullSafe(F.col("__g")) & F.col(value).eqNullSafe(F.col("__v")))
    joined = joined.withColumn("avg_rank", F.col("min_rank") + (F.col("__ties") - 1) / 2.0)
    return joined.select(*rows.columns, F.col("min_rank").cast("int").alias("min_rank"), "avg_rank")


def below_percentile(rows: DataFrame, value: str, p: float) -> DataFrame:
    """Rows whose value is strictly below the exact, interpolated percentile of all (F8)."""
    cut = quantiles(rows, value, p).withColumnRenamed("quantile", "cut")
    return rows.crossJoin(F.broadcast(cut)).filter(F.col(value) < F.col("cut")).drop("cut")  # cut is one row


def popular_with_top_up(rows: DataFrame, group: str, score: str, id_col: str, threshold: float, least: int) -> DataFrame:
    """Rows above the threshold, and in groups with fewer than `least` of them the next best, with their places."""
    placed = numbered(rows, group, [F.desc(score), F.asc(id_col)])
    return placed.withColumn("place", F.col("place").cast("int")).filter((F.col(score) > threshold) | (F.col("place") <= least))


def dense_ids(values: DataFrame, column: str, *first_seen: str) -> DataFrame:
    """Ids from 0 for the distinct values of a column, in the order in which they are first seen.

    Values are dealt to ranges of that order that are about equal in size; places are counted inside a range and moved by the sizes
    of the ranges before. Ranges are as many as tasks.
    """
    seen = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*first_seen)).alias("seen"))
    ranged = materialize(seen.repartitionByRange("seen", column).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    lower = sizes.select(F.col("range").alias("lower"), F.col("n").alias("m"))
    before = sizes.join(F.broadcast(lower), F.col("lower") < F.col("range"), "left").groupBy("range").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))  # a row for each task
    place = F.row_number().over(Window.partitionBy("range").orderBy("seen", column))
    return ranged.withColumn("place", place).join(F.broadcast(before), "range").select(column, (F.col("before") + F.col("place") - 1).alias("label_id"))


def document_tfidf(counts: DataFrame, n_documents: DataFrame, top: int = 100) -> DataFrame:
    """TF-IDF of (doc_id, token, tf): tf * log2(N / df), L2-normalised per document, the best `top` tokens.

    Weights are ranked at nine digits, so that sums in another order don't change places.
    """
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    weighted = counts.join(df, "token").crossJoin(F.broadcast(n_documents))  # one row
    weighted = weighted.withColumn("w", F.col("tf") * F.log2(F.col("n_documents") / F.col("df"))).filter("w > 1e-12")
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    return top_per_group(weighted.withColumn("tfidf", F.col("w") / size), "doc_id", top, F.desc(F.round("tfidf", 9)), F.asc("token"))


def expanded_categories(own: DataFrame, parents: DataFrame, levels: int) -> DataFrame:
    """(article_id, category, level): an article's categories and their parents up to `levels` above.

    own is (article_id, category), parents (category, parent). The hierarchy is joined once for each distinct category and level.
    """
    tops = own.select("category").distinct().withColumn("top", F.col("category")).withColumn("level", F.lit(0))
    last = tops
    for level in range(1, levels + 1):
        above = parents.select(F.col("category").alias("top"), F.col("parent"))
        last = last.join(above, "top").select("category", F.col("parent").alias("top"), F.lit(level).alias("level")).distinct()
        tops = tops.unionByName(last)
    return own.join(tops, "category").select("article_id", F.col("top").alias("category"), "level").distinct()
