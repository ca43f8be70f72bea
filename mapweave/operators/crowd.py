"""Crowd-study analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unpivot_answers(wide: DataFrame, keys: list[str], prefix: str, value: str) -> DataFrame:
    """Long rows (keys, project_no, item_no, value) of the columns <prefix>_<p>_<i> (R1); nulls are dropped."""
    columns = [c for c in wide.columns if c.startswith(f"{prefix}_")]
    cells = F.array(*(F.struct(F.lit(int(c.split("_")[-2])).alias("project_no"), F.lit(int(c.split("_")[-1])).alias("item_no"), F.col(f"`{c}`").cast("string").alias(value)) for c in columns))
    return wide.select(*keys, F.inline(cells)).filter(F.col(value).isNotNull())


def group_parts(group_id: Column) -> Column:
    """struct(name, cluster, group) of an id like name_c3_g7 (C11)."""
    part = lambda i: F.regexp_extract(group_id, r"^(.*)_c(\d+)_g(\d+)$", i)
    return F.struct(part(1).alias("name"), part(2).cast("int").alias("cluster"), part(3).cast("int").alias("group"))


def valid_workers(answers: DataFrame, least_checks: float = 0.5, most_flags: float = 0.6) -> DataFrame:
    """(worker, check_share, flag_share) of the workers to keep.

    answers has worker, is_check and flagged. A worker must have flagged at least that share of the check items and
    at most that share of all; one without check items is out.
    """
    share = answers.groupBy("worker").agg(
        F.avg(F.when(F.col("is_check"), F.col("flagged").cast("double"))).alias("check_share"), F.avg(F.col("flagged").cast("double")).alias("flag_share")
    )
    return share.filter((F.col("check_share") >= least_checks) & (F.col("flag_share") <= most_flags))


def valid_workers_of_all(answers: DataFrame, checks: int, items: int, least_checks: float = 0.5, most_flags: float = 0.5) -> DataFrame:
    """(worker, check_share, flag_share) of the workers to keep, by what their responses showed them.

    answers has worker, response, is_check and flagged, and may hold only what was flagged: each response counts as `checks` check items of
    `items` items in all, whether they are among the answers or not. Null flags count as none; answers without a worker or response are left out.
    """
    own = answers.filter("worker is not null and response is not null")
    flag = F.coalesce(F.col("flagged"), F.lit(False))
    per = own.groupBy("worker", "response").agg(F.sum((flag & F.coalesce(F.col("is_check"), F.lit(False))).cast("long")).alias("caught"), F.sum(flag.cast("long")).alias("flags"))
    share = per.groupBy("worker").agg((F.sum("caught") / (F.count("*") * checks)).alias("check_share"), (F.sum("flags") / (F.count("*") * items)).alias("flag_share"))
    return share.filter((F.col("check_share") >= least_checks) & (F.col("flag_share") <= most_flags))


def exposures(seen: DataFrame, keys: list[str]) -> DataFrame:
    """exposures, flags and their ratio by keys."""
    counts = seen.groupBy(*keys).agg(F.count("*").alias("exposures"), F.sum(F.col("flagged").cast("long")).alias("flags"))
    return counts.withColumn("ratio", F.col("flags") / F.col("exposures"))


def borda(votes: DataFrame, keys: list[str], places: int = 5) -> DataFrame:
    """votes, borda (the sum of places - rank), its mean, and the share of the group's points (A25, A26). Ranks start at 0."""
    scored = votes.groupBy(*keys).agg(F.count("*").alias("votes"), F.sum(places - F.col("rank")).cast("long").alias("borda"))
    whole = scored.groupBy(*keys[:-1]).agg(F.sum("borda").alias("__whole"))
    joined = scored.join(whole, keys[:-1]) if len(keys) > 1 else scored.crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn("avg_borda", F.col("borda") / F.col("votes")).withColumn("share", F.col("borda") / F.nullif("__whole", F.lit(0))).drop("__whole")


def clean_labels(labels: DataFrame, exact: list[str], parts: list[str], column: str = "label") -> DataFrame:
    """Labels that aren't on a list of words and contain none of the parts."""
    kept = labels.filter(F.col(column).isNotNull() & ~F.col(column).isin(exact or [""]))
    for part in parts:
        kept = kept.filter(~F.col(column).contains(part))
    return kept


def stacked(*sources: DataFrame, fill: float = 0.0) -> DataFrame:
    """The rows of all sources, one after another, with every column that any has: numbers that a source lacks, or that are null, are `fill`.

    Columns go by name. Texts and other values that aren't numbers stay null; equal rows stay apart. A column's type must fit in all sources.
    """
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows.fillna(fill)


def feature_matrix(scores: DataFrame, sources: list[str]) -> DataFrame:
    """A row per (country, label) with a column per source, 0 where it has no score."""
    return scores.groupBy("country", "label").pivot("source", sources).agg(F.sum("score")).fillna(0.0, sources)


def _hashed(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def shuffled_groups(rows: DataFrame, id_col: str, size: int, rounds: int, seed: int = 11, decoys: list[int] | None = None) -> DataFrame:
    """(country, round, group, place, id): in each round the country's rows in a hashed order, cut into chunks.

    With decoys every chunk has one of them, at a hashed place, among size - 1 rows; a chunk that is short is filled up with rows from the
    start of the order.
    """
    turn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = Window.partitionBy("country", "round").orderBy(_hashed(F.col(id_col).cast("string"), F.col("round").cast("string"), F.lit(str(seed))), id_col)
    own = size - 1 if decoys else size
    placed = turn.withColumn("n", F.row_number().over(order) - 1)
    if not decoys:
        return placed.select("country", "round", F.floor(F.col("n") / size).alias("group"), (F.col("n") % size).alias("place"), id_col)
    sizes = placed.groupBy("country", "round").agg(F.count("*").alias("all"))
    short = F.pmod(-F.col("all"), F.lit(own))
    filled = placed.join(sizes, ["country", "round"])
    filled = filled.select("country", "round", "n", id_col).unionByName(filled.filter(F.col("n") < F.least(short, "all")).select("country", "round", (F.col("n") + F.col("all")).alias("n"), id_col))
    filled = filled.withColumn("group", F.floor(F.col("n") / own))
    number = lambda what: F.conv(F.substring(_hashed(F.col("country").cast("string"), F.col("round").cast("string"), F.col("group").cast("string"), F.lit(what)), 1, 6), 16, 10).cast("long")
    at = number("place") % size
    inside = filled.withColumn("p", F.col("n") % own).select("country", "round", "group", (F.col("p") + F.when(F.col("p") >= at, 1).otherwise(0)).alias("place"), F.col(id_col).cast("long").alias(id_col))
    extra = filled.select("country", "round", "group").distinct()
    chosen = F.element_at(F.array(*(F.lit(d).cast("long") for d in decoys)), (number("decoy") % len(decoys) + 1).cast("int"))
    return inside.unionByName(extra.select("country", "round", "group", at.alias("place"), chosen.alias(id_col)))


def top_voted(votes: DataFrame, keys: list[str], blacklist: DataFrame, n: int = 10) -> DataFrame:
    """(keys, label, points, place): the n labels with the most points that aren't on the list (label), null labels left out."""
    allowed = votes.filter("label is not null").join(blacklist.select("label").distinct(), "label", "left_anti")
    points = allowed.groupBy(*keys, "label").agg(F.sum("points").alias("points"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("points"), "label"))
    return points.withColumn("place", place).filter(F.col("place") <= n)


def unit_tf_idf(labels: DataFrame, articles: DataFrame) -> DataFrame:
    """(project, cluster, label, tfidf) of labels and articles (project, cluster, article) by study unit.

    Labels meet the articles of their unit many to many (J21): tf is the label's part of the unit's pairs, with one more, idf the log of
    the project's articles over the label's pairs and ten. Pairs are counted, as rows of the label times rows of the unit, and not made.
    """
    unit = ["project", "cluster"]
    held = articles.groupBy(*unit).agg(F.count("*").alias("held"))
    base = labels.groupBy(*unit, "label").agg(F.count("*").alias("own")).join(held, unit)
    base = base.select(*unit, "label", (F.col("own") * F.col("held")).alias("clc"))
    ncl = base.groupBy(*unit).agg(F.sum("clc").alias("ncl"))
    lc = base.groupBy("label").agg(F.sum("clc").alias("lc"))
    n = articles.groupBy("project").agg(F.count_distinct("article").alias("n"))
    joined = base.join(ncl, unit).join(lc, "label").join(n, "project")
    return joined.select(*unit, "label", (F.col("clc") / (F.col("ncl") + 1) * F.log(F.col("n") / (F.col("lc") + 10))).alias("tfidf"))


def training_rows(vectors: DataFrame, clusters: DataFrame, gold: DataFrame) -> DataFrame:
    """Vectors with their country and its first gold label."""
    return vectors.join(clusters.select("article_id", "country"), "article_id").join(gold.select("country", "label"), "country")


def with_source_flags(rows: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """rows with a 0/1 column per source: whether the key is there."""
    for name, table in sources.items():
        flag = table.select(key).distinct().withColumn(name, F.lit(1))
        rows = rows.join(flag, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def gold_articles(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose first mid-level category starts with the prefix."""
    return rows.filter((F.size("mid_level_categories") > 0) & F.get("mid_level_categories", F.lit(0)).startswith(prefix))


def label_matches(chosen: DataFrame, truth: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(country, label, truth, exact, subset): chosen labels against the true ones, by word sets.

    synonyms (word, synonym) also lets a word stand for another.
    """
    words = lambda c: F.array_distinct(F.split(F.lower(c), "[ _]+"))
    pairs = chosen.select("country", "label").join(truth.select("country", F.col("label").alias("truth")), "country")
    pairs = pairs.withColumn("exact", F.lower("label") == F.lower("truth"))
    known = words(F.col("truth"))
    if synonyms is not None:
        more = truth.select("country", F.col("label").alias("truth"), F.explode(words(F.col("label"))).alias("word")).join(synonyms, "word")
        more = more.groupBy("country", "truth").agg(F.collect_set("synonym").alias("more"))
        pairs = pairs.join(more, ["country", "truth"], "left")
        known = F.concat(known, F.coalesce("more", F.array().cast("array<string>")))
    return pairs.withColumn("subset", F.size(F.array_except(words(F.col("label")), known)) == 0).select("country", "label", "truth", "exact", "subset")
