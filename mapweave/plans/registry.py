"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.text import content_tokens
from mapweave.operators.labels import listed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its own name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# The binding of the data model to the supplied tables: articles are documents, countries and vectors come from embeddings.


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, article_id, vector, country, x, y)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("article_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("country"))
    return rows.withColumn("x", F.get("vector", F.lit(0))).withColumn("y", F.get("vector", F.lit(1)))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("label").alias("country"))


def article_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, pos, token): all content tokens, in order."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.posexplode(content_tokens("text", 3, [""])).alias("pos", "token"))


def label_lists(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(article_id, labels): the distinct tokens of each article, in a list; with `of` only of articles that are there.

    A document holds all of its article, so tokens are neither shuffled nor sorted; only where ids repeat are documents brought together.
    """
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    repeated = not rows.groupBy("article_id").count().filter("count > 1").isEmpty()
    if of is not None:
        rows = rows.join(of.select("article_id"), "article_id", "left_semi")
    lists = rows.select("article_id", F.array_distinct(content_tokens("text", 3, [""])).alias("labels"))
    if repeated:
        lists = lists.groupBy("article_id").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"))
    return lists


def article_labels(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(article_id, label): the distinct tokens of each article, or of those in `of`."""
    return label_lists(spark, sf_dir, of).select("article_id", F.explode("labels").alias("label"))


def article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_counts() of the articles' labels and countries."""
    placed = countries(spark, sf_dir)
    return listed_counts(label_lists(spark, sf_dir, placed).join(placed, "article_id"))


#: The same as article_labels joined with countries, in SQL.
SQL_LABELS = """
tok as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as token from documents),
al as (select distinct doc_id, token as label from tok where length(token) > 2),
b as (select e.label as country, al.label, al.doc_id from al join embeddings e on al.doc_id = e.vec_id where e.label is not null),
base as (select country, label, count(*) as clc from b group by 1, 2),
ncl as (select country, sum(clc) as ncl from base group by 1),
lcp as (select label, sum(clc) as lcp from base group by 1),
nca as (select country, count(distinct doc_id) as n_country_articles from b group by 1),
tot as (select count(distinct doc_id) as n_articles, count(distinct label) as n_labels from b),
counts as (select base.country, base.label, clc, ncl::double as ncl, lcp::double as lcp, n_country_articles::double as nca, n_articles::double as na, n_labels::double as nl
  from base join ncl using (country) join lcp using (label) join nca using (country) cross join tot)
"""
