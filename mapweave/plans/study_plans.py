"""Crowd-study queries: events stand in for answers, labels for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators import crowd as R
from mapweave.operators import metrics as M
from mapweave.operators import topics
from mapweave.plans.registry import query, r6, table, vectors

_SEEN = """s as (select user_id % 50 as worker, event_type as label, user_id % 5 as country, (event_id % 4 = 0) as is_check, (coalesce(value, 0) > 25) as flagged, event_id % 5 as rank from events)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    flagged = F.coalesce("value", F.lit(0.0)) > 25
    return e.select(
        (F.col("user_id") % 50).alias("worker"), F.col("event_type").alias("label"), (F.col("user_id") % 5).alias("country"),
        (F.col("event_id") % 4 == 0).alias("is_check"), flagged.alias("flagged"), (F.col("event_id") % 5).alias("rank"),
    )


@query(f"""with {_SEEN}, w as (select worker, avg(case when is_check then flagged::int::double end) as check_share, avg(flagged::int::double) as flag_share from s group by 1)
select worker, round(check_share, 6) as check_share, round(flag_share, 6) as flag_share from w where check_share >= 0.5 and flag_share <= 0.6""")
def worker_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, R3, A24."""
    return R.valid_workers(_seen(spark, sf_dir)).select("worker", r6("check_share").alias("check_share"), r6("flag_share").alias("flag_share"))


@query("""with a as (select user_id % 50 as worker, user_id as response, event_id % 4 = 0 as is_check, value > 30 as flagged from events),
r as (select worker, response, sum((flagged and is_check)::int) as caught, sum(flagged::int) as flags from a group by 1, 2),
w as (select worker, sum(caught) / (count(*) * 18)::double as check_share, sum(flags) / (count(*) * 72)::double as flag_share from r group by 1)
select worker, round(check_share, 6) as check_share, round(flag_share, 6) as flag_share from w where check_share >= 0.5 and flag_share <= 0.5""")
def worker_filter_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all items that a worker's responses showed; users stand in for responses, of 72 items with 18 checks."""
    answers = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("worker"), F.col("user_id").alias("response"), (F.col("event_id") % 4 == 0).alias("is_check"), (F.col("value") > 30).alias("flagged"),
    )
    kept = R.valid_workers_of_all(answers, 18, 72)
    return kept.select("worker", r6("check_share").alias("check_share"), r6("flag_share").alias("flag_share"))


@query(f"""with {_SEEN}, b as (select country, label, count(*) as votes, sum(5 - rank)::bigint as borda from s group by 1, 2)
select country, label, votes, borda, round(borda / votes::double, 6) as avg_borda, round(borda / sum(borda) over (partition by country)::double, 6) as share from b""")
def borda_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, A26."""
    found = R.borda(_seen(spark, sf_dir), ["country", "label"])
    return found.select("country", "label", "votes", "borda", r6("avg_borda").alias("avg_borda"), r6("share").alias("share"))


@query(f"with {_SEEN} select country, label, count(*) as exposures, sum(flagged::int)::bigint as flags, round(sum(flagged::int) / count(*)::double, 6) as ratio from s group by 1, 2")
def vote_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, A29."""
    return R.exposures(_seen(spark, sf_dir), ["country", "label"]).withColumn("ratio", r6("ratio"))


@query(f"""with {_SEEN}, c as (select country, label, worker, count(*) as n from s where flagged group by 1, 2, 3 having count(*) > 2) select country, label, count(*) as workers from c group by 1, 2""")
def gold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a worker flagged more than twice."""
    counts = _seen(spark, sf_dir).filter("flagged").groupBy("country", "label", "worker").agg(F.count("*").alias("n")).filter("n > 2")
    return counts.groupBy("country", "label").agg(F.count("*").alias("workers"))


_TYPES = ["Brand#11", "Brand#12", "Brand#13"]


@query("""with s as (select p_size as country, p_type as label, p_brand as source, sum(p_retailprice) as v from part group by 1, 2, 3), t as (select distinct country, label from s)
select t.country, t.label, round(coalesce(sum(v) filter (source = 'Brand#11'), 0), 4) as "Brand#11", round(coalesce(sum(v) filter (source = 'Brand#12'), 0), 4) as "Brand#12", round(coalesce(sum(v) filter (source = 'Brand#13'), 0), 4) as "Brand#13"
from t join s using (country, label) group by 1, 2""")
def feature_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6, F16."""
    scores = table(spark, sf_dir, "part").select(F.col("p_size").alias("country"), F.col("p_type").alias("label"), F.col("p_brand").alias("source"), F.col("p_retailprice").alias("score"))
    wide = R.feature_matrix(scores, _TYPES)
    return wide.select("country", "label", *(F.round(F.col(f"`{c}`"), 4).alias(c) for c in _TYPES))


@query(f"""with {_SEEN}, g as (select country, label, row_number() over (partition by country order by count(*) desc, label) as rank from s where flagged group by 1, 2),
c as (select distinct country, label from s) select round(avg(coalesce(rank / 5.0::double, 1.2::double)), 6) as gold_score from c left join (select * from g where rank <= 3) g using (country, label)""")
def gold_rank_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9."""
    from mapweave.operators.labels import top_per_group

    seen = _seen(spark, sf_dir)
    counts = seen.filter("flagged").groupBy("country", "label").agg(F.count("*").alias("n"))
    gold = top_per_group(counts, "country", 3, F.desc("n"), F.asc("label")).select("country", "label", F.col("place").alias("rank"))
    return M.gold_rank_score(seen.select("country", "label").distinct(), gold).select(r6("gold_score").alias("gold_score"))


@query("""select c_custkey, 'label' as kind, i::int as item_no, case i when 1 then c_name when 2 then c_mktsegment else c_acctbal::bigint::varchar end as value from customer, unnest(generate_series(1, 2)) as g(i)""")
def unpivot_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide rows to long ones."""
    wide = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("label_0_1"), F.col("c_mktsegment").alias("label_0_2"))
    return R.unpivot_answers(wide, ["c_custkey"], "label", "value").select("c_custkey", F.lit("label").alias("kind"), "item_no", "value")


@query("""with t as (select c_nationkey as country, c_custkey as article_id, r as round from customer, unnest(generate_series(0, 4)) as g(r)),
n as (select *, row_number() over (partition by country, round order by md5(concat_ws('|', article_id, round, 11)), article_id) - 1 as n from t) select country, round::int as round, n // 31 as group, (n % 31)::int as place, article_id from n""")
def shuffled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hashed orders cut into chunks of 31."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), F.col("c_custkey").alias("article_id"))
    return R.shuffled_groups(rows, "article_id", 31, 5)


_NUMBER = "('0x' || substr(md5(concat_ws('|', country, round, \"group\", '{}')), 1, 6))::bigint"


@query(f"""with t as (select c_nationkey as country, c_custkey as article_id, r as round from customer, unnest(generate_series(0, 4)) as g(r)),
n as (select *, row_number() over (partition by country, round order by md5(concat_ws('|', article_id, round, 11)), article_id) - 1 as n, count(*) over (partition by country, round) as a from t),
f as (select country, round, n, article_id from n union all select country, round, n + a, article_id from n where n < least((30 - a % 30) % 30, a)), g as (select *, n // 30 as "group", n % 30 as p from f),
h as (select *, {_NUMBER.format('place')} % 31 as pos, {_NUMBER.format('decoy')} % 3 + 1 as d from g)
select country, round::int as round, "group", p + (p >= pos)::int as place, article_id from h union all select distinct country, round::int, "group", pos, -d from h""")
def groups_with_decoys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty rows and a decoy (negative ids) in each chunk of 31."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("country"), F.col("c_custkey").alias("article_id"))
    return R.shuffled_groups(rows, "article_id", 31, 5, decoys=[-1, -2, -3])


@query("select event_type as algorithm, sum(event_id % 5 + 1)::bigint as points from events group by 1")
def coherency_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from one to five for each answer."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("algorithm")).agg(F.sum(F.col("event_id") % 5 + 1).alias("points"))


@query("""with t as (select p_brand as country, p_type as label, sum(p_retailprice) as tfidf, null::bigint as votes from part where p_size <= 30 group by 1, 2),
k as (select p_brand as country, p_type as label, null::double as tfidf, count(*) as votes from part where p_size > 20 group by 1, 2)
select country, label, round(coalesce(tfidf, 0), 4) as tfidf, coalesce(votes, 0)::bigint as votes from (select * from t union all select * from k)""")
def stacked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sources with columns of their own, one after another."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("country"), F.col("p_type").alias("label"), "p_size", "p_retailprice")
    scores = part.filter("p_size <= 30").groupBy("country", "label").agg(F.sum("p_retailprice").alias("tfidf"))
    votes = part.filter("p_size > 20").groupBy("country", "label").agg(F.count("*").alias("votes"))
    return R.stacked(scores, votes).withColumn("tfidf", F.round("tfidf", 4))


@query("""with v as (select p_brand as country, p_type as label, sum(p_size)::bigint as points from part where p_type not like 'PROMO%' group by 1, 2),
r as (select *, row_number() over (partition by country order by points desc, label) as place from v) select country, label, points, place::int as place from r where place <= 10""")
def top_voted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes stand in for votes, promoted types for the list."""
    part = table(spark, sf_dir, "part")
    listed = part.filter(F.col("p_type").startswith("PROMO")).select(F.col("p_type").alias("label"))
    votes = part.select(F.col("p_brand").alias("country"), F.col("p_type").alias("label"), F.col("p_size").cast("long").alias("points"))
    return R.top_voted(votes, ["country"], listed)


@query("""with s as (select p_brand as group_id, p_type as label, sum(p_retailprice) as score from part where p_size <= 30 group by 1, 2), v as (select p_brand as group_id, p_type as label, count(*) as votes from part where p_size > 20 group by 1, 2)
select coalesce(s.group_id, v.group_id) as group_id, coalesce(s.label, v.label) as label, round(score, 4) as score, votes from s full outer join v on s.group_id = v.group_id and s.label = v.label""")
def scores_and_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outer join on two keys."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("group_id"), F.col("p_type").alias("label"), "p_size", "p_retailprice")
    scores = part.filter("p_size <= 30").groupBy("group_id", "label").agg(F.round(F.sum("p_retailprice"), 4).alias("score"))
    return scores.join(part.filter("p_size > 20").groupBy("group_id", "label").agg(F.count("*").alias("votes")), ["group_id", "label"], "outer")


@query("""with l as (select p_brand as project, p_size % 7 as cluster, p_type as label from part), a as (select p_brand as project, p_size % 7 as cluster, p_name as article from part),
b as (select project, cluster, label, count(*) as clc from l join a using (project, cluster) group by 1, 2, 3), n as (select project, cluster, sum(clc) as ncl from b group by 1, 2), t as (select label, sum(clc) as lc from b group by 1), z as (select project, count(distinct article) as n from a group by 1)
select project, cluster, label, round(clc / (ncl + 1)::double * ln(n / (lc + 10)::double), 6) as tfidf from b join n using (project, cluster) join t using (label) join z using (project)""")
def study_unit_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, J21."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), (F.col("p_size") % 7).alias("cluster"), F.col("p_type").alias("label"), F.col("p_name").alias("article"))
    return R.unit_tf_idf(part.select("project", "cluster", "label"), part.select("project", "cluster", "article")).withColumn("tfidf", r6("tfidf"))


@query("""select e.vec_id as article_id, e.label as country, 'gold ' || e.label as label, round(e.embedding[1]::double, 6) as first from embeddings e where e.label is not null""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9."""
    v = vectors(spark, sf_dir)
    gold = v.select("country").distinct().select("country", F.concat(F.lit("gold "), "country").alias("label"))
    return R.training_rows(v.select("article_id", "vector"), v.select("article_id", "country"), gold).select("article_id", "country", "label", r6(F.get("vector", F.lit(0))).alias("first"))


@query("""select c_custkey, (c_custkey in (select o_custkey from orders where o_orderstatus = 'F'))::int as filled, (c_custkey in (select o_custkey from orders where o_orderpriority like '1%'))::int as urgent from customer""")
def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, J18."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    sources = {"filled": orders.filter("o_orderstatus = 'F'"), "urgent": orders.filter("o_orderpriority like '1%'")}
    return R.with_source_flags(table(spark, sf_dir, "customer").select("c_custkey"), sources, "c_custkey")


_OLS = """d as (select p_partkey, p_brand, p_size::double as a, length(p_type)::double as b, p_retailprice as y from part),
s as (select avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as by_ from d),
w as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as wb from s), f as (select d.*, my + wa * (a - ma) + wb * (b - mb) as prediction from d cross join w)"""


@query(f"with {_OLS} select p_partkey, round(prediction, 4) as prediction from f")
def label_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model of the price of parts by size and type."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.length("p_type").cast("double").alias("letters"), F.col("p_retailprice").alias("price"))
    model, assembler = topics.fit_regression(rows, ["size", "letters"], "price")
    return topics.predict(model, assembler, rows).select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query(f"with {_OLS} select feature, round(coefficient, 6) as coefficient from (select 'size' as feature, wa as coefficient from w union all select 'letters', wb from w union all select 'intercept', my - wa * ma - wb * mb from w)")
def regression_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K18."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("size"), F.length("p_type").cast("double").alias("letters"), F.col("p_retailprice").alias("price"))
    model, _ = topics.fit_regression(rows, ["size", "letters"], "price")
    return topics.coefficients(spark, model, ["size", "letters"]).withColumn("coefficient", r6("coefficient"))


@query("""select c_mktsegment as weight, round(avg(c_acctbal), 4) as mean, count(*) as n from customer group by 1""")
def sweep_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A30."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("weight")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.count("*").alias("n"))


@query(f"""with {_OLS}, k as (select *, rank() over (partition by p_brand order by round(prediction, 9) desc) as place from f), t as (select *, row_number() over (partition by p_brand order by y desc, place) as true_ from k),
r as (select avg(place) as rank_of_best from t where true_ = 1), m as (select 1 - sum((y - prediction) ** 2) / sum((y - my) ** 2) as r2 from f cross join s) select round(r2, 6) as r2, round(rank_of_best, 6) as rank_of_best from m cross join r""")
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K18, by brand."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("size"), F.length("p_type").cast("double").alias("letters"), F.col("p_retailprice").alias("price"))
    model, assembler = topics.fit_regression(rows, ["size", "letters"], "price")
    report = topics.regression_report(topics.predict(model, assembler, rows), "price", "p_brand")
    return report.select(r6("r2").alias("r2"), r6("rank_of_best").alias("rank_of_best"))


@query("""with c as (select n_regionkey as country, lower(n_name) as label from nation), t as (select r_regionkey as country, lower(r_name) as label from region)
select c.country, c.label, t.label as truth, c.label = t.label as exact, len(list_filter(regexp_split_to_array(c.label, '[ _]+'), lambda w: not list_contains(regexp_split_to_array(t.label, '[ _]+'), w))) = 0 as subset
from c join t using (country)""")
def label_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names against region names."""
    chosen = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("country"), F.lower("n_name").alias("label"))
    truth = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("country"), F.lower("r_name").alias("label"))
    return R.label_matches(chosen, truth)


@query("select doc_id from documents where contains(source, '1') and starts_with(lang, 'e')")
def gold_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages stand in for categories."""
    rows = table(spark, sf_dir, "documents").filter(F.col("source").contains("1"))
    return R.gold_articles(rows.select("doc_id", F.array("lang").alias("mid_level_categories")), "e").select("doc_id")
