"""Titles, links, popularity, text mining and label scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mapweave.functions.text import category_name, content_tokens, display_name, is_article_title, is_topic_category, tokens
from mapweave.operators import labels as L
from mapweave.operators import topics
from mapweave.operators.factors import label_svd
from mapweave.operators.hdp import hdp
from mapweave.operators.ranks import numbered
from mapweave.plans.registry import SQL_LABELS, article_counts, article_labels, article_tokens, countries, query, r6, table, vectors
from mapweave.runtime import materialize, release
from mapweave.sources.tables import latest_metrics, map_document, page_links as links_of, page_titles as titles_of
from mapweave.streaming.popularity import windowed_popularity

_V = "v as (select vec_id as id, embedding::double[] as e, label as country from embeddings where embedding is not null)"
_TITLES = "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages"
_MONTHS = "['list','january','february','march','april','may','june','july','august','september','october','november','december']"


@query(_TITLES)
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4."""
    return titles_of(table(spark, sf_dir, "pages"))


@query(f"""with t as ({_TITLES}) select page_id, title from t where not regexp_matches(title, '[0-9]{{4}} ') and not regexp_matches(title, '[0-9]$')
and not contains(title, 'Category') and not list_has_any(regexp_split_to_array(lower(title), '\\s+'), {_MONTHS})""")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 over all titles (F2 is limit() before it)."""
    return titles_of(table(spark, sf_dir, "pages")).filter(is_article_title("title"))


@query("""select page_id, (i - 1)::int as place, l[i] as link from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as l from pages),
unnest(generate_series(1, len(l))) as g(i)""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4, S6."""
    return links_of(table(spark, sf_dir, "pages"))


def _popularity(spark: SparkSession, sf_dir: str, days: int, in_order: bool = False) -> DataFrame:
    """(article_id, popularity): exact sums, or with in_order the doubles added by event_id, for ranks, in which the rounding of that sum tells equal sums apart."""
    events = table(spark, sf_dir, "events").filter("value is not null")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.make_interval(days=F.lit(days)))  # one row
    recent = recent.withColumn("article_id", F.col("user_id"))
    if in_order:
        return L.summed_in_order(recent, "article_id", "value", "event_id", "popularity")
    return recent.groupBy("article_id").agg(L.exact_sum("value").alias("popularity"))


def _popularity_sql(days: int) -> str:
    return f"""select user_id as article_id, sum(value) as popularity from events where value is not null
    and ts >= (select max(ts) from events) - interval {days} day group by 1"""


@query(f"select article_id, round(popularity, 4) as popularity from ({_popularity_sql(365)})")
def popularity_365d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8, A22, C16."""
    return _popularity(spark, sf_dir, 365).withColumn("popularity", F.round("popularity", 4))


@query(f"select article_id, round(popularity, 4) as popularity from ({_popularity_sql(7)})")
def popularity_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _popularity(spark, sf_dir, 7).withColumn("popularity", F.round("popularity", 4))


@query("select user_id as article_id, date_trunc('day', ts) as start, round(sum(value), 4) as popularity from events where value is not null group by 1, 2")
def popularity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the whole table."""
    return windowed_popularity(table(spark, sf_dir, "events")).withColumn("popularity", F.round("popularity", 4))


@query(f"""with p as ({_popularity_sql(365)}), m as (select min(popularity) as lo, max(popularity) as hi from p)
select article_id, round(coalesce((popularity - lo) / nullif(hi - lo, 0), 0), 6) as scaled from p cross join m""")
def popularity_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, C21."""
    p = _popularity(spark, sf_dir, 365)
    m = p.agg(F.min("popularity").alias("lo"), F.max("popularity").alias("hi"))
    scaled = (F.col("popularity") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return p.crossJoin(F.broadcast(m)).select("article_id", r6(F.coalesce(scaled, F.lit(0.0))).alias("scaled"))  # one row


@query(f"""with p as ({_popularity_sql(365)}), j as (select article_id, popularity, label as country from p join embeddings on article_id = vec_id),
r as (select *, row_number() over (partition by country order by popularity desc, article_id) - 1 as x from j)
select article_id, country, case when x < 1 then 30.0 when x < 15 then 18.0 when x < 45 then 10.0 when x < 100 then 6.0 when x < 250 then 3.0 else 0.5 end::double as size from r""")
def popularity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, by country."""
    p = _popularity(spark, sf_dir, 365, in_order=True).join(countries(spark, sf_dir), "article_id")
    p = numbered(p, "country", [F.desc("popularity"), F.asc("article_id")])
    x = F.col("place") - 1
    size = F.when(x < 1, 30.0).when(x < 15, 18.0).when(x < 45, 10.0).when(x < 100, 6.0).when(x < 250, 3.0).otherwise(0.5)
    return p.select("article_id", "country", size.alias("size"))


_STOP = "['the','and','for','that','was','are','with','this','from','der','die','das','und','les','des','que','los','las']"
_CONTENT = f"""t as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) as token from documents),
c as (select doc_id, token, count(*) as tf from t where length(token) > 2 and not list_contains({_STOP}, token) group by 1, 2)"""


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(content_tokens("text")).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query(f"with {_CONTENT} select * from c")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, A20."""
    return _token_counts(spark, sf_dir)


@query(f"""with {_CONTENT}, d as (select token, count(*) as df from c group by 1), n as (select count(*)::double as n from documents),
w as (select doc_id, token, tf * log2(n / df) as w from c join d using (token) cross join n),
s as (select doc_id, token, w / sqrt(sum(w * w) over (partition by doc_id)) as tfidf from w where w > 1e-12),
r as (select *, row_number() over (partition by doc_id order by round(tfidf, 9) desc, token) as place from s)
select doc_id, token, round(tfidf, 6) as tfidf, place::int as place from r where place <= 100""")
def doc_tfidf_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, T6."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n_documents"))
    ranked = L.document_tfidf(_token_counts(spark, sf_dir), n)
    return ranked.select("doc_id", "token", r6("tfidf").alias("tfidf"), "place")


_SEQ = """t as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: length(x) > 0) as w from documents)"""
_BIGRAMS = f"""{_SEQ}, p as (select doc_id, unnest(w) as a, unnest(list_concat(w[2:], [null])) as b from t),
u as (select a as word, count(*) as n from p group by 1), v as (select count(*)::double as v from u),
ab as (select a, b, count(*) as n from p where b is not null group by 1, 2 having count(*) >= 10),
s as (select ab.a, ab.b, ab.n, (ab.n - 10) * v / (ua.n * ub.n) as score from ab join u ua on ua.word = ab.a join u ub on ub.word = ab.b cross join v)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens("text").alias("w"))


@query(f"with {_BIGRAMS} select a, b, n, round(score, 6) as score from s")
def bigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams seen ten times or more."""
    return topics.collocations(_words(spark, sf_dir), 10, -1.0).withColumn("score", r6("score"))


def _merged_sql(source: str, out: str, least: int) -> str:
    """Greedy joining from the left: of an unbroken row of pairs that are phrases the first, third and so on are joined."""
    return f"""{out}_p as (select doc_id, i, w[i] as a, w[i + 1] as b from {source}, unnest(generate_series(1, len(w))) as t(i)),
{out}_u as (select a as word, count(*) as n from {out}_p group by 1), {out}_v as (select count(*)::double as v from {out}_u),
{out}_g as (select a, b from (select a, b, count(*) as n from {out}_p where b is not null group by 1, 2 having count(*) >= {least}) ab join {out}_u ua on ua.word = a join {out}_u ub on ub.word = b cross join {out}_v where (ab.n - {least}) * v / (ua.n * ub.n) > 10),
{out}_m as (select p.*, g.a is not null as good from {out}_p p left join {out}_g g on p.a = g.a and p.b = g.b),
{out}_k as (select *, case when good then row_number() over (partition by doc_id, good order by i) - i end as island from {out}_m),
{out}_h as (select *, good and (i - min(i) over (partition by doc_id, island)) % 2 = 0 as joins from {out}_k),
{out}_t as (select doc_id, i, case when joins then a || '_' || b else a end as word, coalesce(lag(joins) over (partition by doc_id order by i), false) as taken from {out}_h),
{out} as (select s.doc_id, coalesce(x.w, []::varchar[]) as w from {source} s left join (select doc_id, list(word order by i) as w from {out}_t where not taken group by 1) x using (doc_id))"""


@query(f"with {_SEQ}, {_merged_sql('t', 'once', 30)}, {_merged_sql('once', 'twice', 10)} select doc_id, array_to_string(w, ' ') as text from twice")
def phrase_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first pass with pairs seen 30 times, a second over its result with ten."""
    words = materialize(_words(spark, sf_dir), "words")
    once = materialize(topics.with_phrases(words, 30), "phrases")
    release(words)
    return topics.with_phrases(once, 10).select("doc_id", F.array_join("w", " ").alias("text"))


@query(f"""with {_SEQ}, k as (select word, count(*) as n from (select unnest(w) as word from t) group by 1),
r(tail, put) as (values ('s', ''), ('ses', 's'), ('ves', 'f'), ('xes', 'x'), ('zes', 'z'), ('ches', 'ch'), ('shes', 'sh'), ('men', 'man'), ('ies', 'y')),
c as (select k.word, o.word as lemma, o.n as m from k join r on ends_with(k.word, r.tail) join k o on o.word = k.word[: length(k.word) - length(r.tail)] || r.put)
select word, n, coalesce((select c.lemma from c where c.word = k.word order by c.m desc, c.lemma limit 1), word) as lemma from k""")
def lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singulars that the documents themselves hold."""
    return topics.lemmas(_words(spark, sf_dir).select(F.explode("w").alias("word")))


@query(f"""with {_SEQ}, c as (select doc_id, list_filter(w, lambda x: length(x) > 2) as w from t), n as (select count(*)::double as n from c),
g as (select doc_id, i - 1 as first, length as length, array_to_string(w[i : i + length - 1], ' ') as phrase from c, unnest(generate_series(1, len(w))) as p(i), unnest([1, 2, 3]) as q(length) where i + length - 1 <= len(w)),
f as (select doc_id, phrase, length, count(*) as tf from g group by all having count(*) >= 4 and min(first) < 200), z as (select doc_id, sum(tf) as a, sum(case when length > 1 then tf else 0 end) as l from f group by 1),
d as (select word as phrase, count(distinct doc_id) as df from (select doc_id, unnest(w) as word from c) group by 1),
s as (select doc_id, phrase, tf * log2(n / case when length > 1 then 1 else df end) * case when length > 1 then least(3.0, a / (l * 2.3::double)) else 1.0 end as score from f join z using (doc_id) left join d using (phrase) cross join n),
r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, phrase) as place from s) select doc_id, phrase, round(score, 6) as score, place::int as place from r where place <= 10""")
def kp_miner_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4."""
    words = table(spark, sf_dir, "documents").select("doc_id", content_tokens("text", 3, [""]).alias("w"))
    return topics.kp_miner(words).withColumn("score", r6("score"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_counts(spark, sf_dir)


@query(f"with {SQL_LABELS} select country, label, clc, ncl::bigint as ncl, lcp::bigint as lcp from counts")
def cluster_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A3, A4."""
    return _counts(spark, sf_dir).select("country", "label", "clc", "ncl", "lcp")


def _top5(score: str) -> str:
    return f"""with {SQL_LABELS}, s as (select country, label, clc, {score} as score from counts),
r as (select *, row_number() over (partition by country order by round(score, 9) desc, label) as place from s) select country, label, clc, round(score, 6) as score from r where place <= 5"""


def _best(rows: DataFrame, n: int = 5) -> DataFrame:
    top = L.top_per_group(rows, "country", n, F.desc(F.round("score", 9)), F.asc("label"))
    return top.select("country", "label", "clc", r6("score").alias("score"))


@query(_top5("clc / ncl * ln(na / (lcp + 10))"))
def cluster_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best labels of each country."""
    return _best(_counts(spark, sf_dir).withColumn("score", L.tf_idf()))


@query(_top5("clc / (ncl + 1) * ln(na / (lcp + 10))"))
def cluster_tfidf_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    return _best(_counts(spark, sf_dir).withColumn("score", L.tf_idf_smoothed()))


@query(_top5("clc / (ncl + 1) * na / (lcp + 0.25::double * nca)"))
def cluster_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return _best(_counts(spark, sf_dir).withColumn("score", L.pmi()))


@query(f"""with {SQL_LABELS}, s as (select *, clc / ncl * ln(na / (lcp + 10)) as tfidf from counts),
w as (select *, coalesce((tfidf - min(tfidf) over (partition by country)) / nullif(max(tfidf) over (partition by country) - min(tfidf) over (partition by country), 0), 0) as scaled from s)
select country, label, round(scaled, 6) as scaled, round(clc / ncl * ln(nl / (6 * lcp)) * tfidf, 9) as score from w""")
def hcat_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, W1."""
    scored = L.hierarchy_score(_counts(spark, sf_dir).withColumn("tfidf", L.tf_idf()))
    return scored.select("country", "label", r6("scaled").alias("scaled"), F.round("score", 9).alias("score"))


@query("""with t as (select doc_id, lang, source, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as label from documents),
v as (select distinct lang, source, label from t where length(label) > 2), f as (select label, count(*) as label_count from v group by 1)
select lang, source, count(*) as labels, sum(label_count)::bigint as total from v join f using (label) group by 1, 2""")
def vocab_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: each (lang, source) is a vocabulary; how often its labels are in any."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = docs.select("lang", "source", F.explode(content_tokens("text", 3, [""])).alias("label")).distinct()
    often = vocabulary.groupBy("label").agg(F.count("*").alias("label_count"))
    return vocabulary.join(often, "label").groupBy("lang", "source").agg(F.count("*").alias("labels"), F.sum("label_count").alias("total"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("country", "label", L.tf_idf().alias("score"))


def _exclusive_sql(n: int, blacklist: str = "''") -> str:
    """The sequential choice: in each step the best row whose label is free and whose country has room."""
    return f"""with recursive {SQL_LABELS}, s as materialized (select country, label, clc / ncl * ln(na / (lcp + 10)) as score from counts where label not in ({blacklist})),
pick(k, country, label, score, used, full_) as (select 0, null::int, null::varchar, null::double, []::varchar[], []::int[]
  union all select p.k + 1, b.best.country, b.best.label, b.best.score, list_append(p.used, b.best.label), list_append(p.full_, b.best.country)
  from pick p, lateral (select arg_min({{'country': country, 'label': label, 'score': score}}, (-score, label, country)) as best from s
    where not list_contains(p.used, s.label) and len(list_filter(p.full_, lambda x: x = s.country)) < {n}) b where b.best is not null)
select country, label, round(score, 6) as score from pick where k > 0"""


@query(_exclusive_sql(10))
def label_exclusive_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten labels a country, none twice."""
    return L.exclusive_top_n(_scored(spark, sf_dir), 10).withColumn("score", r6("score"))


@query(_exclusive_sql(1, "'the', 'and'"))
def label_best_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, with a blacklist."""
    return L.exclusive_top_n(_scored(spark, sf_dir), 1, blacklist=["the", "and"]).withColumn("score", r6("score"))


@query()
def label_union_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labels a country by tf-idf and five by PMI, no stem twice in either, equal rows once."""
    counts = _counts(spark, sf_dir)
    chosen = [L.exclusive_top_n(counts.select("country", "label", score.alias("score")), 5, distinct_stems=True).select("country", "label") for score in (L.tf_idf_smoothed(), L.pmi())]
    return chosen[0].unionByName(chosen[1]).distinct()


@query("select l_orderkey, l_linenumber, count(*) over (partition by l_partkey) as label_count from lineitem")
def label_id_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3b."""
    return L.rows_per(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey").select("l_orderkey", "l_linenumber", "label_count")


@query("""with m as (select label as country, vec_id::varchar as v from embeddings), c as (select country, list(distinct v order by v) as l from m group by 1)
select country, array_to_string(l, '|') || repeat('|', greatest(0, 600 - len(l))::int) as members from c""")
def country_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded to 600."""
    return L.members(countries(spark, sf_dir), "country", "article_id", 600).select("country", F.array_join("values", "|").alias("members"))


@query(f"""with t as (select page_id, title from ({_TITLES}) order by page_id limit 100) select page_id, title from t where not regexp_matches(title, '[0-9]{{4}} ') and not regexp_matches(title, '[0-9]$')
and not contains(title, 'Category') and not list_has_any(regexp_split_to_array(lower(title), '\\s+'), {_MONTHS})""")
def title_filter_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first hundred titles, and then the filter."""
    return titles_of(table(spark, sf_dir, "pages")).orderBy("page_id").limit(100).filter(is_article_title("title"))


@query("""select c.c_custkey as article_id, n.n_name as category, 0 as level from customer c join nation n on c.c_nationkey = n.n_nationkey
union select c.c_custkey, r.r_name, 1 from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey""")
def category_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A category and its parents, one level up."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    parents = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("category"), F.col("r_name").alias("parent"))
    own = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("article_id"), F.col("n_name").alias("category"))
    return L.expanded_categories(own, parents, 1)


@query("""with c as (select p_partkey, 'Category:Types of ' || p_type || case when p_size % 3 = 0 then ' by ' || p_brand else '' end as category from part)
select p_partkey, replace(case when instr(category, ' by') > 0 then substr(category, 1, instr(category, ' by') - 1) else replace(category, 'Types of ', '') end, 'Category:', '') as name
from c where not contains(lower(category), 'redirect') and not contains(lower(category), 'disambiguation')""")
def category_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3, F5."""
    by = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" by "), "p_brand")).otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Category:Types of "), "p_type", by).alias("category"))
    return rows.filter(is_topic_category("category")).select("p_partkey", category_name("category").alias("name"))


@query(f"""with {SQL_LABELS}, r as (select country, label, clc, rank() over (partition by country order by clc desc) as min_rank, count(*) over (partition by country, clc) as ties from base)
select country, label, min_rank::int as min_rank, (min_rank + (ties - 1) / 2.0::double)::double as avg_rank from r""")
def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2."""
    ranked = L.average_rank(_counts(spark, sf_dir), "country", "clc")
    return ranked.select("country", "label", "min_rank", "avg_rank")


@query(f"""with p as ({_popularity_sql(365)}), j as (select article_id, popularity, label as country from p join embeddings on article_id = vec_id),
r as (select *, row_number() over (partition by country order by popularity desc, article_id) as place from j) select article_id, country, place::int as place from r where popularity > 2000 or place <= 30""")
def topup_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9."""
    rows = _popularity(spark, sf_dir, 365, in_order=True).join(countries(spark, sf_dir), "article_id")
    return L.popular_with_top_up(rows, "country", "popularity", "article_id", 2000.0, 30).select("article_id", "country", "place")


@query("""with s as (select c_custkey as article_id, c_mktsegment as label from customer union all select o_custkey, o_orderpriority from orders),
f as (select label, min(article_id) as seen from s group by 1), i as (select label, row_number() over (order by seen, label) - 1 as label_id from f)
select s.article_id, i.label_id, count(*) as n from s join i using (label) group by 1, 2""")
def combined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sources one after another, with dense ids in the order in which labels are first seen."""
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id"), F.col("c_mktsegment").alias("label"))
    two = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("article_id"), F.col("o_orderpriority").alias("label"))
    both = one.unionByName(two)
    return both.join(L.dense_ids(both, "label", "article_id"), "label").groupBy("article_id", "label_id").agg(F.count("*").alias("n"))


@query("select distinct regexp_replace(trim(lower(p_type)), '\\s+', '_', 'g') as label, p_brand as source from part")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, F19, C10."""
    return table(spark, sf_dir, "part").select(display_name("p_type").alias("label"), F.col("p_brand").alias("source")).dropDuplicates()


@query("select doc_id as article_id from documents where doc_id not in (select vec_id from embeddings where vec_id is not null)")
def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without a vector."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id")).join(own, "article_id", "left_anti")


@query("""select coalesce(d.doc_id, l.doc_id) as article_id, case when l.doc_id is null then 'left_only' when d.doc_id is null then 'right_only' else 'both' end as source
from documents d full outer join labels l on d.doc_id = l.doc_id""")
def outer_with_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, J6, J8."""
    d, l = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"))  # noqa: E741
    source = F.when(F.col("l").isNull(), "left_only").when(F.col("d").isNull(), "right_only").otherwise("both")
    return d.join(l, F.col("d") == F.col("l"), "outer").select(F.coalesce("d", "l").alias("article_id"), source.alias("source"))


@query(f"""with p as ({_popularity_sql(365)}) select p.article_id, c.c_name || '|' || round(p.popularity, 2)::decimal(18,2)::varchar || '|' || e.label::varchar as document
from p join customer c on c.c_custkey = p.article_id join embeddings e on e.vec_id = p.article_id""")
def merged_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of joins behind the map document, as text."""
    p = _popularity(spark, sf_dir, 365)
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id"), "c_name")
    text = F.concat_ws("|", "c_name", F.round("popularity", 2).cast("decimal(18,2)").cast("string"), F.col("country").cast("string"))
    return p.join(names, "article_id").join(countries(spark, sf_dir), "article_id").select("article_id", text.alias("document"))


def _document_sql(more: str = "", joins: str = "") -> str:
    short = lambda x: f"({x})::decimal(18,3)::varchar"
    return f"""with {_V}, p as ({_popularity_sql(365)}) select p.article_id, '{{"Article":"' || c_name || '","Popularity":' || {short("popularity")} || ',"Country":' || country::varchar || ',"x":' || {short("e[1]")} || ',"y":' || {short("e[2]")}{more} || '}}' as document
from p join customer on c_custkey = p.article_id join v on v.id = p.article_id{joins}"""


def _map_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("article_id"), F.col("c_name").alias("article_name"))
    return names, _popularity(spark, sf_dir, 365), countries(spark, sf_dir), vectors(spark, sf_dir).select("article_id", "x", "y")


@query(_document_sql())
def map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4, S10, C17."""
    return map_document(*_map_tables(spark, sf_dir))


@query(_document_sql(""" || ',"relevance":' || (o_totalprice / 1000000)::decimal(18,3)::varchar""", " join orders on o_orderkey = p.article_id"))
def map_documents_with_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order totals stand in for distances; articles without one have no field and are left out here."""
    far = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), (F.col("o_totalprice") / 1000000).alias("distance"))
    names, *others = _map_tables(spark, sf_dir)
    return map_document(names.join(far, "article_id", "left_semi"), *others, relevance=far)


@query("select event_type as metric, arg_max(value, event_id) as value from events where value is not null group by 1")
def metric_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log; the last value of each metric."""
    rows = table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("metric"), "value", F.col("event_id").alias("line"))
    return latest_metrics(rows)


@query(f"""with {SQL_LABELS}, dp as (select vec_id as doc_id, label % 3 as topic, 0.75::double as prob from embeddings union all select vec_id, (label + 1) % 3, 0.25::double from embeddings),
tw as (select country % 3 as topic, label as word, sum(clc)::double as n from base group by 1, 2), tp as (select topic, word, n / sum(n) over (partition by topic) as q from tw),
top as (select * from (select *, row_number() over (partition by topic order by q desc, word) as p from tp) where p <= 150),
m as (select doc_id, word, sum(prob * q) as prob from dp join top using (topic) group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by round(prob, 12) desc, word) as place from m) select doc_id, word, round(prob, 9) as prob, place::int as place from r where place <= 100""")
def lda_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by topics times topics by words; topics stand in for a fitted model."""
    e = table(spark, sf_dir, "embeddings")
    shares = e.select(F.col("vec_id").alias("doc_id"), F.inline(F.array(F.struct((F.col("label") % 3).alias("topic"), F.lit(0.75).alias("prob")), F.struct(((F.col("label") + 1) % 3).alias("topic"), F.lit(0.25).alias("prob")))))
    words = _counts(spark, sf_dir).groupBy((F.col("country") % 3).alias("topic"), F.col("label").alias("word")).agg(F.sum("clc").cast("double").alias("n"))
    sizes = words.groupBy("topic").agg(F.sum("n").alias("size"))
    words = words.join(sizes, "topic").withColumn("prob", F.col("n") / F.col("size"))
    top = L.top_per_group(words, "topic", 150, F.desc("prob"), F.asc("word")).select("topic", "word", "prob")
    return topics.lda_mixture(shares, top).select("doc_id", "word", F.round("prob", 9).alias("prob"), "place")


@query("""with s as (select vec_id as doc_id, i - 1 as topic, embedding[i]::double as prob from embeddings, unnest(generate_series(1, 7)) as g(i)) select doc_id, arg_max(topic, (prob, -topic))::int as country from s group by 1""")
def topic_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of seven shares."""
    shares = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.posexplode(F.slice("embedding", 1, 7)).alias("topic", "prob"))
    return topics.topic_of_document(shares)


@query()
def lda_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 over a fitted model: each document's hundred likeliest words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_tokens("text").alias("words"))
    return topics.lda_mixture(*topics.lda(docs)).withColumn("prob", F.round("prob", 9))


@query()
def lsi_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent semantic factors, the decomposition of the documents' tf-idf weights."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").cast("double").alias("n_documents"))
    weights = L.document_tfidf(_token_counts(spark, sf_dir), n)
    return label_svd(weights.select(F.col("doc_id").alias("article_id"), F.col("token").alias("label"), F.col("tfidf").alias("weight")), 7)


@query()
def hdp_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many topics as the documents ask for, their shares and words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_tokens("text").alias("words"))
    return hdp(docs)[1]


@query()
def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven topics and their words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_tokens("text").alias("words"))
    return topics.lda(docs)[1]


@query()
def text_rank_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2."""
    return topics.text_rank(table(spark, sf_dir, "documents").select("doc_id", content_tokens("text").alias("words")))


@query(f"""with {SQL_LABELS} select country, label, clc from (select *, row_number() over (partition by country order by clc desc, label) as p from base) where p = 1""")
def most_used_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, W3."""
    return L.top_per_group(_counts(spark, sf_dir), "country", 1, F.desc("clc"), F.asc("label")).select("country", "label", "clc")


@query("""with t as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as token from documents) select length(token)::int as letters, count(*) as n, count(distinct token) as words from t where length(token) > 2 group by 1""")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = article_tokens(spark, sf_dir).groupBy(F.length("token").alias("letters"), "token").agg(F.count("*").alias("c"))
    return rows.groupBy("letters").agg(F.sum("c").alias("n"), F.count("*").alias("words"))


@query(f"""with {SQL_LABELS}, r as (select country as topic, label as word, row_number() over (partition by country order by clc / ncl desc, label) as place from counts), top10 as (select * from r where place <= 10),
df as (select label as word, count(*)::double as df from al group by 1), pr as (select x.topic, x.word as a, y.word as b from top10 x join top10 y on x.topic = y.topic and y.place < x.place),
co as (select x.label as a, y.label as b, count(*) as n from al x join al y on x.doc_id = y.doc_id and x.label <> y.label where x.label in (select word from top10) and y.label in (select word from top10) group by 1, 2)
select topic, round(avg(ln((coalesce(n, 0) + 1.0::double) / df)), 6) as u_mass from pr left join co using (a, b) join df on df.word = pr.b group by 1""")
def topic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries stand in for topics."""
    words = article_labels(spark, sf_dir).select(F.col("article_id").alias("doc_id"), F.col("label").alias("word"))
    by_topic = _counts(spark, sf_dir).select(F.col("country").alias("topic"), F.col("label").alias("word"), (F.col("clc") / F.col("ncl")).alias("prob"))
    return topics.coherence(by_topic, words).select("topic", r6("u_mass").alias("u_mass"))
