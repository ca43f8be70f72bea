"""Scans and sinks."""

from __future__ import annotations

import html as _html
import json
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ARTICLE = T.StructType([T.StructField("article_id", T.LongType()), T.StructField("article_name", T.StringType())])
TEXT = T.StructType([*ARTICLE.fields, T.StructField("text", T.StringType())])
CLUSTER = T.StructType([T.StructField("article_id", T.LongType()), T.StructField("country", T.IntegerType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, quoted_breaks: bool = False) -> DataFrame:
    """A CSV file with a header (S1). Line breaks inside quotes need quoted_breaks, with which a file can't be split among tasks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=quoted_breaks, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and without an index column."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines of text files; within a file `at` follows their order, whichever task reads them."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def read_vectors(spark: SparkSession, path: str, keep_other_lengths: bool = True) -> DataFrame:
    """(title, vector, as_head) of text files of vectors, plain or compressed: a head line "rows dims", then a title and numbers (S3).

    The head is the first line of each file, where it holds two whole numbers. Lines with a value that is no number are left out.
    as_head tells whether the vector has as many values as the head says (null without a head); without keep_other_lengths the others go.
    """
    lines = numbered_lines(spark, path)
    whole = lambda i: F.get("parts", F.lit(i)).try_cast("int")
    first = lines.groupBy("file").agg(F.min("at").alias("first"), F.min_by("value", "at").alias("head")).withColumn("parts", F.split(F.trim("head"), " "))
    dims = F.when((F.size("parts") == 2) & whole(0).isNotNull() & whole(1).isNotNull(), whole(1))
    rows = lines.join(first.select("file", "first", dims.alias("dims")), "file").filter(F.col("dims").isNull() | (F.col("at") != F.col("first")))
    rows = rows.withColumn("parts", F.split(F.trim("value"), " ")).filter(F.size("parts") > 1)
    vector = F.transform(F.slice("parts", F.lit(2), F.size("parts") - 1), lambda x: x.try_cast("double"))
    out = rows.select(F.get("parts", F.lit(0)).alias("title"), vector.alias("vector"), (F.size("parts") - 1 == F.col("dims")).alias("as_head"))
    out = out.filter(~F.exists("vector", lambda x: x.isNull()))
    return out if keep_other_lengths else out.filter(F.coalesce("as_head", F.lit(True)))


def missing_titles(vectors: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((article_id, article_name, vector), concepts without one): joined by title, with spaces as underscores."""
    name = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    named = concepts.select("article_id", "article_name", name("article_name").alias("__title"))
    placed = vectors.select(name("title").alias("__title"), "vector")
    return named.join(placed, "__title").drop("__title"), named.join(placed, "__title", "left_anti").drop("__title")


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, title) of stored pages."""
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, link) of the links of stored pages."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("place", "link"))


def read_metric_log(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value): the last value of each key of logs of JSON lines (S9, S16). Files follow each other by their paths."""
    lines = numbered_lines(spark, path).select(F.from_json("value", "map<string,string>").alias("m"), F.struct("file", "at").alias("line"))
    return latest_metrics(lines.select(F.explode("m").alias("metric", "value"), "line"))


def append_parameters(spark: SparkSession, path: str, parameters: dict[str, object]) -> None:
    """Add a run's parameters to a log, one JSON line for each."""
    lines = [(i, json.dumps({k: v})) for i, (k, v) in enumerate(parameters.items())]
    spark.createDataFrame(lines, "i int, value string").coalesce(1).orderBy("i").select("value").write.mode("append").text(path)


def latest_metrics(rows: DataFrame) -> DataFrame:
    """(metric, value) with the largest line of each metric."""
    return rows.groupBy("metric").agg(F.max_by("value", "line").alias("value"))


def map_document(articles: DataFrame, popularity: DataFrame, countries: DataFrame, layout: DataFrame, relevance: DataFrame | None = None) -> DataFrame:
    """(article_id, document): an article's entry of the map as JSON, numbers to three places.

    relevance (article_id, distance) adds that field (F18).
    """
    joined = articles.join(popularity, "article_id").join(countries, "article_id").join(layout, "article_id")
    short = lambda c, name: F.col(c).cast("decimal(18,3)").alias(name)
    fields = [F.col("article_name").alias("Article"), short("popularity", "Popularity"), F.col("country").alias("Country"), short("x", "x"), short("y", "y")]
    if relevance is not None:
        joined = joined.join(relevance, "article_id", "left")
        fields.append(short("distance", "relevance"))
    return joined.select("article_id", F.to_json(F.struct(*fields)).alias("document"))


def geojson(polygons: DataFrame, labels: DataFrame) -> DataFrame:
    """(country, feature): a GeoJSON MultiPolygon feature for each country (S11). Each of polygons has rings, its outline first and then its holes."""
    rings = lambda p: F.transform(p["rings"], lambda r: F.transform(r, lambda q: F.array(q["x"], q["y"])))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.col("country").alias("clusterID"), F.col("label").alias("label")).alias("properties"),
        F.struct(F.lit("MultiPolygon").alias("type"), F.transform("polygons", rings).alias("coordinates")).alias("geometry"),
    )
    return polygons.join(labels, "country", "left").select("country", F.to_json(feature).alias("feature"))


def feature_collection(features: DataFrame, most: int = 10_000) -> str:
    """One GeoJSON document of at most `most` country features."""
    rows = features.orderBy("country").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("more countries than a single document takes")
    return json.dumps({"type": "FeatureCollection", "features": [json.loads(r["feature"]) for r in rows]})


def svg(cells: DataFrame, titles: DataFrame, size: float, most: int = 20_000) -> str:
    """An SVG drawing of coloured cells (cx, cy, colour) and titles (x, y, text, points); bounded by `most` elements."""
    squares, texts = cells.limit(most + 1).collect(), titles.limit(most + 1).collect()
    if max(len(squares), len(texts)) > most:
        raise ValueError("more elements than a drawing takes")
    body = [f'<rect x="{r.cx * size}" y="{r.cy * size}" width="{size}" height="{size}" fill="{r.colour}"/>' for r in squares]
    body += [f'<text x="{r.x}" y="{r.y}" font-size="{r.points}">{_html.escape(r.text)}</text>' for r in texts]
    return '<svg xmlns="http://www.w3.org/2000/svg">' + "".join(body) + "</svg>"


_PAGE = Template("<html><body><h1>$title</h1><table>$rows</table></body></html>")


def html_report(title: str, metrics: DataFrame, most: int = 1000) -> str:
    """A page with a table of at most `most` metrics; more are an error."""
    found = metrics.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("more metrics than a page takes")
    rows = "".join(f"<tr><td>{_html.escape(str(r[0]))}</td><td>{_html.escape(str(r[1]))}</td></tr>" for r in found)
    return _PAGE.substitute(title=_html.escape(title), rows=rows)


def next_experiment_id(runs: DataFrame) -> int:
    """One more than the largest id of a table of runs."""
    return (runs.agg(F.max("experiment_id")).first()[0] or 0) + 1


def padded_side_by_side(tables: list[DataFrame], order: str) -> DataFrame:
    """Tables of one column each next to each other by row number within a group, shorter ones padded by nulls."""
    numbered = [t.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy(order))) for t in tables]
    out = numbered[0]
    for i, t in enumerate(numbered[1:], 1):
        out = out.join(t.withColumnRenamed(order, f"{order}_{i}"), ["group", "n"], "outer")
    return out
