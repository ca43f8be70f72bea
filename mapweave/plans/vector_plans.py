"""Clustering, neighbours, quality metrics and geometry over the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions.vectors import cosine_distance, euclidean, l2_normalised
from mapweave.operators import cluster as C
from mapweave.operators import labels as L
from mapweave.operators import metrics as M
from mapweave.operators import spatial as S
from mapweave.operators import tsne, voronoi
from mapweave.operators.layout import neighbour_layout as neighbour_embedding
from mapweave.operators.neighbours import nearest_graph
from mapweave.operators.plane import nearest_in_plane
from mapweave.operators.quantiles import quantiles
from mapweave.plans.registry import SQL_LABELS, label_lists, query, r6, vectors
from mapweave.runtime import materialize
from mapweave.sources.tables import geojson

_V = "v as (select vec_id as id, embedding::double[] as e, label as country from embeddings where embedding is not null)"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"


def _cos(a: str, b: str) -> str:
    return f"(1 - {_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)})))"


def _euclid(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def _centres(damping: str, group: str = "country", source: str = "v") -> str:
    return f"""(select {group}, list(m order by i) as c from (select {group}, i, sum(x) / (count(*) + {damping}) as m from (select {group}, unnest(e) as x, unnest(generate_series(1, len(e))) as i from {source}) group by 1, 2) group by 1)"""


_LAYOUT_KNN = """d as (select a.id, b.id as other, sqrt((a.e[1] - b.e[1]) ** 2 + (a.e[2] - b.e[2]) ** 2) as dist from v a join v b on a.id <> b.id),
k as (select * from (select *, row_number() over (partition by id order by dist, other) as place from d) where place <= {k}),
g as (select least(id, other) as u, greatest(id, other) as v, max(dist) as weight from k group by 1, 2)"""


@query(f"with {_V}, c as {_centres('1e-6')} select country, i::int as pos, round(c[i], 6) as mean from c, unnest(generate_series(1, len(c))) as g(i)")
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    found = C.centroids(vectors(spark, sf_dir))
    return found.select("country", F.posexplode("centroid").alias("pos", "mean")).select("country", (F.col("pos") + 1).alias("pos"), r6("mean").alias("mean"))


@query(f"with {_V}, c as {_centres('1e-6')} select id, c.country as other, round({_cos('e', 'c')}, 6) as distance from v cross join c")
def cosine_to_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the ten centroids, which are broadcast."""
    v = vectors(spark, sf_dir)
    centres = C.centroids(v).withColumnRenamed("country", "other")  # one row a country
    return v.crossJoin(F.broadcast(centres)).select("id", "other", r6(cosine_distance("vector", "centroid")).alias("distance"))


@query(f"with {_V}, c as {_centres('1e-6')}, d as (select v.country, {_cos('e', 'c')} as d from v join c using (country)) select country, round(avg(d), 6) as mean_distance from d group by 1")
def centroid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31."""
    v = vectors(spark, sf_dir)
    return v.join(C.centroids(v), "country").groupBy("country").agg(r6(F.avg(cosine_distance("vector", "centroid"))).alias("mean_distance"))


@query(f"""with {_V}, s as (select row_number() over (order by id) - 1 as k, e as c from v order by id limit 8),
d as (select v.id, s.k, {_cos('v.e', 's.c')} as d from v cross join s)
select id as article_id, k::int as country, round(d, 6) as distance from (select *, row_number() over (partition by id order by d, k) as p from d) where p = 1""")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assignment of eight clusters."""
    v = vectors(spark, sf_dir).filter("vector is not null")
    return C.assign(v, C.seeds(v, 8)).select("article_id", "country", r6("distance").alias("distance"))


_KMEANS = f"""v2 as (select id, e, row_number() over (order by id) - 1 as n from v),
lloyd(step, k, c, shift) as (select 0, n, e, 1e9::double from v2 where n < 8 union all
  select s.step + 1, s.k, coalesce(m.c, s.c), max(list_sum(list_transform(list_zip(coalesce(m.c, s.c), s.c), lambda z: abs(z[1] - z[2])))) over () from lloyd s left join
    (select k, list(x order by i) as c from (select k, i, sum(x) / (count(*) + 1e-6) as x from (select k, unnest(e) as x, unnest(generate_series(1, len(e))) as i from
      (select v2.id, any_value(v2.e) as e, arg_min(o.k, ({_cos('v2.e', 'o.c')}, o.k)) as k from lloyd o cross join v2 group by v2.id)) group by 1, 2) group by 1) m on m.k = s.k where s.shift >= 5e-5),
last as (select k, c from lloyd where step = (select max(step) from lloyd))"""


@query(f"""with recursive {_V}, {_KMEANS} select id as article_id, arg_min(k, (d, k))::int as country, round(min(d), 6) as distance from (select v.id, k, {_cos('v.e', 'last.c')} as d from v cross join last) group by 1""")
def kmeans_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 to convergence."""
    return C.kmeans_cosine(vectors(spark, sf_dir), 8)[0].select("article_id", "country", r6("distance").alias("distance"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label lists of the articles that have a vector, written once for their readers."""
    return materialize(label_lists(spark, sf_dir, vectors(spark, sf_dir)), "lists", collect=False)


def _weights(spark: SparkSession, sf_dir: str, lists: DataFrame | None = None) -> DataFrame:
    """Label weights: the inverse document frequency of tokens in five articles or more."""
    lists = _lists(spark, sf_dir) if lists is None else lists
    labels = lists.select("article_id", F.explode("labels").alias("label"))
    n = lists.filter("size(labels) > 0").agg(F.count("*").alias("n"))
    df = labels.groupBy("label").agg(F.count("*").alias("df")).filter("df >= 5")
    return labels.join(df, "label").crossJoin(F.broadcast(n)).select("article_id", "label", F.log(F.col("n") / F.col("df")).alias("weight"))  # one row


@query()
def joint_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: vectors, layout and labels."""
    return C.joint_kmeans(vectors(spark, sf_dir), _weights(spark, sf_dir), 8).withColumn("distance", r6("distance"))


def _candidates(spark: SparkSession, sf_dir: str, lists: DataFrame) -> DataFrame:
    """Five labels a country, by tf-idf over the vectors' own countries."""
    counts = L.listed_counts(lists.join(vectors(spark, sf_dir).select("article_id", "country"), "article_id")).withColumn("score", L.tf_idf())
    return L.top_per_group(counts, "country", 5, F.desc(F.round("score", 9)), F.asc("label")).select("country", "label")


@query()
def joint_kmeans_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6."""
    lists = _lists(spark, sf_dir)
    return C.joint_kmeans(vectors(spark, sf_dir), _weights(spark, sf_dir, lists), 8, candidates=_candidates(spark, sf_dir, lists)).withColumn("distance", r6("distance"))


@query()
def joint_kmeans_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: five neighbours in the plane."""
    v = vectors(spark, sf_dir)
    return C.joint_kmeans(v, None, 8, plane_weight=0.0, label_sign=1, neighbours=nearest_in_plane(v, 5)).withColumn("distance", r6("distance"))


@query()
def joint_kmeans_two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7."""
    return C.joint_kmeans(vectors(spark, sf_dir), _weights(spark, sf_dir), 8, two_stages=True).withColumn("distance", r6("distance"))


@query(f"""with {SQL_LABELS}, sc as (select country, label, clc, row_number() over (partition by country order by round(clc / ncl * ln(na / (lcp + 10)), 9) desc, label) as place from counts), ca as (select country, label from sc where place <= 5),
va as (select al.doc_id, al.label from al join embeddings e on al.doc_id = e.vec_id), vn as (select count(distinct doc_id) as n from va), vd as (select label, count(*) as df from va group by 1 having count(*) >= 5),
wt as (select doc_id, va.label, ln(n / df) as weight from va join vd using (label) cross join vn), to_ as (select e.label as country, wt.label, sum(weight) as total from wt join embeddings e on e.vec_id = wt.doc_id group by 1, 2),
r as (select ca.country, ca.label, coalesce(total, 0) as total from ca left join to_ using (country, label)) select country, label, round(total, 6) as total from (select *, row_number() over (partition by country order by round(total, 9) desc, label) as p from r) where p = 1""")
def final_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9."""
    lists = _lists(spark, sf_dir)
    return C.final_labels(_weights(spark, sf_dir, lists), vectors(spark, sf_dir), _candidates(spark, sf_dir, lists)).withColumn("total", r6("total"))


@query()
def vectors_with_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors, label factors and the country's place in one."""
    found = C.with_factors(vectors(spark, sf_dir), C.label_svd(_weights(spark, sf_dir), 10), 10)
    return found.select("article_id", F.transform("augmented", lambda x: F.round(x, 6)).alias("augmented"))


@query("""with t as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as token from documents), al as (select distinct doc_id, token as label from t where length(token) > 2),
b as (select e.label as country, al.label from al join embeddings e on al.doc_id = e.vec_id), s as (select country, label, count(*)::double as n from b group by 1, 2)
select country, label, round(n / sqrt(sum(n * n) over (partition by country)), 6) as weight from s""")
def cluster_label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    weighted = label_lists(spark, sf_dir, vectors(spark, sf_dir)).select("article_id", F.explode("labels").alias("label")).withColumn("weight", F.lit(1.0))
    return C.label_vectors(weighted, vectors(spark, sf_dir)).withColumn("weight", r6("weight"))


@query("""with t as (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) as token from documents), al as (select distinct doc_id, token as label from t where length(token) > 2),
b as (select e.label as country, al.label from al join embeddings e on al.doc_id = e.vec_id), s as (select country, label, count(*)::double as n from b group by 1, 2),
z as (select label as country, count(*)::double as members from embeddings group by 1),
r as (select country, s.label, n / members as mean, row_number() over (partition by country order by n / members desc, s.label) as place from s join z using (country))
select country, label, round(mean, 6) as mean, place::int as place from r where place <= 20""")
def cluster_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, T7."""
    weighted = label_lists(spark, sf_dir, vectors(spark, sf_dir)).select("article_id", F.explode("labels").alias("label")).withColumn("weight", F.lit(1.0))
    top = C.top_mean_labels(weighted, vectors(spark, sf_dir).select("article_id", "country"))
    return top.select("country", "label", r6("mean").alias("mean"), "place")


@query(f"with {_V} select id, i::int as pos, case when i <= len(e) then round(e[i], 6) when i - len(e) - 1 = country then 1.0::double else 0.0::double end as value from v, unnest(generate_series(1, len(e) + 10)) as g(i)")
def onehot_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K11, K12."""
    rows = C.with_one_hot(vectors(spark, sf_dir), 10)
    return rows.select("id", F.posexplode("augmented").alias("p", "value")).select("id", (F.col("p") + 1).alias("pos"), r6("value").alias("value"))


@query()
def label_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10."""
    return C.label_svd(_weights(spark, sf_dir), 10)


@query(f"with {_V}, {_LAYOUT_KNN.format(k=14)} select u, v, round(weight, 6) as weight from g")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """14 neighbours in the plane."""
    return M.knn_edges(vectors(spark, sf_dir), 14).select("u", "v", r6("weight").alias("weight"))


@query(f"with {_V} select a.id as u, b.id as v, round(sqrt((a.e[1] - b.e[1]) ** 2 + (a.e[2] - b.e[2]) ** 2), 6) as distance from v a join v b on a.id < b.id and (a.e[1] - b.e[1]) ** 2 + (a.e[2] - b.e[2]) ** 2 <= 0.0004::double")
def range_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at most 0.02 apart in the plane."""
    return M.range_pairs(vectors(spark, sf_dir).select("id", "x", "y"), 0.02).withColumn("distance", r6("distance"))


@query(f"with {_V}, {_LAYOUT_KNN.format(k=5)}, s as (select k.id, avg((a.country = b.country)::int::double) as share from k join v a on a.id = k.id join v b on b.id = k.other group by 1) select id, round(share, 6) as share from s")
def neighbour_homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12, J15."""
    return M.neighbour_homogeneity(vectors(spark, sf_dir), 5).withColumn("share", r6("share"))


@query(f"""with {_V}, {_LAYOUT_KNN.format(k=14)}, p as (select a.country as cu, b.country as cv from g join v a on a.id = g.u join v b on b.id = g.v), m as (select count(*)::double as m from p),
t as (select c, sum(i) as l, sum(d) as d from (select cu as c, (cu = cv)::int::double as i, 1.0::double as d from p union all select cv, 0.0, 1.0 from p) group by 1)
select round(sum(l / m - (d / (2 * m)) ** 2), 6) as modularity from t cross join m""")
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1."""
    v = vectors(spark, sf_dir)
    return M.modularity(M.knn_edges(v, 14), v).select(r6("modularity").alias("modularity"))


@query(f"""with {_V}, {_LAYOUT_KNN.format(k=5)}, f as (select a.id, b.id as other, {_euclid('a.e', 'b.e')} as dist from v a join v b on a.id <> b.id),
r as (select *, row_number() over (partition by id order by dist, other) as rank from f), n as (select count(*)::double as n from v)
select round(1 - 2 / (max(n) * 5 * (2 * max(n) - 16)) * sum(greatest(rank - 5, 0)), 6) as trustworthiness from k join r on k.id = r.id and k.other = r.other cross join n""")
def trustworthiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: the plane against all dimensions."""
    v = vectors(spark, sf_dir)
    return M.trustworthiness(v.select("id", "vector"), v).select(r6("trustworthiness").alias("trustworthiness"))


@query(f"""with {_V}, p as (select a.id, a.country as own, b.country as c, avg({_euclid('a.e', 'b.e')}) as m from v a join v b on a.id <> b.id group by 1, 2, 3),
s as (select id, max(case when c = own then m end) as a, min(case when c <> own then m end) as b from p group by 1)
select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, J17."""
    return M.silhouette(vectors(spark, sf_dir).select("id", "vector", "country")).select(r6("silhouette").alias("silhouette"))


@query(f"""with {_V}, c as {_centres('0')}, w0 as (select 0 as country, e from v), w as {_centres('0', source='w0')}, z as (select country, count(*) as members from v group by 1),
b as (select sum(members * {_cos('c.c', 'w.c')}) as b, count(*) as k from c join z using (country) cross join w), i as (select sum({_cos('e', 'c.c')}) as w, count(*) as n from v join c using (country))
select round(b * (n - k) / (w * (k - 1)), 6) as ch from b cross join i""")
def ch_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4."""
    return M.calinski_harabasz_cosine(vectors(spark, sf_dir)).select(r6("ch").alias("ch"))


@query(f"""with {_V}, c as {_centres('0')}, s as (select country, c.c, avg({_euclid('e', 'c.c')}) as s from v join c using (country) group by 1, 2),
p as (select a.country, max((a.s + b.s) / {_euclid('a.c', 'b.c')}) as m from s a join s b on a.country <> b.country group by 1) select round(avg(m), 6) as davies_bouldin from p""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5."""
    return M.davies_bouldin(vectors(spark, sf_dir)).select(r6("davies_bouldin").alias("davies_bouldin"))


@query("""with t as (select label as a, vec_id % 10 as b, count(*)::double as n from embeddings group by 1, 2), p as (select sum(n * (n - 1) / 2) as p, sum(n) as s from t),
pa as (select sum(s * (s - 1) / 2) as pa from (select sum(n) as s from t group by a)), pb as (select sum(s * (s - 1) / 2) as pb from (select sum(n) as s from t group by b))
select round((p - pa * pb / (s * (s - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (s * (s - 1) / 2)), 6) as adjusted_rand from p cross join pa cross join pb""")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, J20."""
    v = vectors(spark, sf_dir)
    return M.adjusted_rand(v, v.select("article_id", (F.col("id") % 10).alias("country"))).select(r6("adjusted_rand").alias("adjusted_rand"))


@query("""with t as (select label as a, vec_id % 10 as b, count(*)::double as n from embeddings group by 1, 2), ra as (select a, sum(n) as r from t group by 1), cb as (select b, sum(n) as c from t group by 1), z as (select sum(n) as n from t),
mi as (select sum(t.n / z.n * ln(t.n * z.n / (r * c))) as mi from t join ra using (a) join cb using (b) cross join z), ha as (select -sum(r / z.n * ln(r / z.n)) as ha from ra cross join z), hb as (select -sum(c / z.n * ln(c / z.n)) as hb from cb cross join z),
ov as (select r, c, z.n, unnest(generate_series(greatest(1, r + c - z.n)::bigint, least(r, c)::bigint)) as x from ra cross join cb cross join z),
em as (select sum(x / n * ln(n * x / (r * c)) * exp(lgamma(r + 1) + lgamma(c + 1) + lgamma(n - r + 1) + lgamma(n - c + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(c - x + 1) - lgamma(n - r - c + x + 1))) as em from ov)
select round((mi - em) / ((ha + hb) / 2 - em), 6) as ami from mi cross join ha cross join hb cross join em""")
def adjusted_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8."""
    v = vectors(spark, sf_dir)
    return M.adjusted_mutual_information(v, v.select("article_id", (F.col("id") % 10).alias("country"))).select(r6("ami").alias("ami"))


@query(f"""with {_V}, l as (select id, country, unnest(e) as x, unnest(generate_series(1, len(e))) as i from v), vo as (select country, sqrt(sum(p * p)) as size from (select country, i, var_pop(x) as p from l group by 1, 2) group by 1),
vw as (select sqrt(sum(p * p)) as whole from (select i, var_pop(x) as p from l group by 1)), sc as (select avg(size) / max(whole) as scatter, sqrt(sum(size)) / count(*) as reach from vo cross join vw),
c as {_centres('0')}, pr as (select a.country as one, b.country as other, a.c as ca, b.c as cb, list_transform(list_zip(a.c, b.c), lambda z: (z[1] + z[2]) / 2) as m from c a join c b on a.country < b.country),
de as (select one, other, sum(({_euclid('e', 'm')} <= reach)::int)::double as m, greatest(sum(({_euclid('e', 'ca')} <= reach)::int), sum(({_euclid('e', 'cb')} <= reach)::int))::double as most
  from pr join v on v.country = one or v.country = other cross join sc group by 1, 2) select round(any_value(scatter) + avg(coalesce(m / nullif(most, 0), 0)), 6) as s_dbw from de cross join sc""")
def s_dbw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6."""
    return M.s_dbw(vectors(spark, sf_dir).select("id", "vector", "country")).select(r6("s_dbw").alias("s_dbw"))


@query(f"""with {_V}, c as {_centres('1e-6')}, d as (select id, country, {_cos('e', 'c')} as d from v join c using (country)), q as (select quantile_cont(d, 0.9) as cut from d)
select id, country from d cross join q where d < cut""")
def distance_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the nearer nine tenths, strictly below the interpolated percentile."""
    v = vectors(spark, sf_dir)
    rows = v.join(C.centroids(v), "country").select("id", "country", cosine_distance("vector", "centroid").alias("d"))
    return L.below_percentile(rows, "d", 0.9).select("id", "country")


@query("select label as country, round(median(embedding[1]::double), 6) as x, round(median(embedding[2]::double), 6) as y from embeddings group by 1")
def country_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    v = vectors(spark, sf_dir)
    x, y = (quantiles(v, c, 0.5, "country").select(F.col("country").alias(f"country_{c}"), r6("quantile").alias(c)) for c in "xy")
    return x.join(y, F.col("country_x").eqNullSafe(F.col("country_y"))).select(F.col("country_x").alias("country"), "x", "y")


_BOX = "b as (select min(embedding[1]::double * 100) - 30 as x0, max(embedding[1]::double * 100) + 30 as x1, min(embedding[2]::double * 100) - 30 as y0, max(embedding[2]::double * 100) + 30 as y1 from embeddings)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"), "country")


@query(f"with {_BOX} select round(x0, 6) as x0, round(x1, 6) as x1, round(y0, 6) as y0, round(y1, 6) as y1 from b")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1."""
    return S.bounding_box(_points(spark, sf_dir)).select(*(r6(c).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query(f"""with {_BOX}, r as (select r as ring, x0 - 10 * r as x0, x1 + 10 * r as x1, y0 - 10 * r as y0, y1 + 10 * r as y1 from b, unnest(generate_series(0, 4)) as g(r)),
h as (select ring, x0 + i as x, y0, y1 from r, unnest(generate_series(0, floor(x1 - x0)::bigint)) as g(i)), w as (select ring, y0 + i as y, x0, x1 from r, unnest(generate_series(0, floor(y1 - y0)::bigint)) as g(i)),
p as (select ring, x, y0 as y from h union select ring, x, y1 from h union select ring, x0, y from w union select ring, x1, y from w) select ring::int as ring, count(*) as n, round(sum(x), 3) as sx, round(sum(y), 3) as sy from p group by 1""")
def water_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings' points, summed up by ring."""
    rings = S.water_rings(S.bounding_box(_points(spark, sf_dir)))
    return rings.groupBy("ring").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("y"), 3).alias("sy"))


_DIFFUSED = f"""{_LAYOUT_KNN.format(k=10)}, gm as (select avg(weight) as mean from g), ew as (select u, v, exp(-((weight / mean) ** 2)) as w from g cross join gm),
bo as (select u, v, w from ew union all select v, u, w from ew), dg as (select u, sum(w) as d from bo group by 1), mo as (select max(a.d + b.d) as most from bo join dg a on bo.u = a.u join dg b on bo.v = b.u),
st as (select v.id as u, 1 - coalesce(d, 0) / most as stay from v left join dg on dg.u = v.id cross join mo),
step as (select bo.u as src, bo.v as dst, bo.w / most as f from bo cross join mo union all select u, u, stay from st),
terms(i, u, c, s, weight) as (select 0, id, country, 1.0::double, exp(-10.0::double) from v
  union all select i + 1, dst, c, sum(s * f), any_value(weight) * 10.0 / (i + 1) from terms join step on src = u where i < 35 group by i, dst, c),
heat as (select u, c, sum(s * weight) as s from terms group by 1, 2), winner as (select u, arg_max(c, (round(s, 12), -c)) as best from heat group by 1)"""


@query(f"with recursive {_V}, {_DIFFUSED} select id, country from v join winner on u = id where best = country")
def denoised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3."""
    v = vectors(spark, sf_dir)
    return S.denoised(v.select("id", "x", "y", "country"), M.knn_edges(v, 10)).select("id", "country")


#: Width of a map cell, and the country number of water.
_CELL, _WATER = 2.0, 10


def _map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    box = S.bounding_box(points)
    return S.voronoi_cells(S.with_water(points, box, _WATER, share=0.0), _CELL, box)


_MAP = f"""{_BOX}, pts as (select embedding[1]::double * 100 as x, embedding[2]::double * 100 as y, label as country from embeddings),
rg as (select r as ring, x0 - 10 * r as x0, x1 + 10 * r as x1, y0 - 10 * r as y0, y1 + 10 * r as y1 from b, unnest(generate_series(0, 4)) as g(r)),
hh as (select ring, x0 + i as x, y0, y1 from rg, unnest(generate_series(0, floor(x1 - x0)::bigint)) as g(i)), ww as (select ring, y0 + i as y, x0, x1 from rg, unnest(generate_series(0, floor(y1 - y0)::bigint)) as g(i)),
sea as (select ring, x, y0 as y from hh union select ring, x, y1 from hh union select ring, x0, y from ww union select ring, x1, y from ww),
al as (select x, y, country from pts union all select x, y, {_WATER} from sea),
oc as (select floor(x / {_CELL})::bigint as cx, floor(y / {_CELL})::bigint as cy, country, count(*) as n from al group by all),
sites as (select cx, cy, arg_max(country, (n, -country)) as country from oc group by 1, 2),
cells as (select cx, cy from b, unnest(generate_series(floor(x0 / {_CELL})::bigint, floor(x1 / {_CELL})::bigint)) as g(cx), unnest(generate_series(floor(y0 / {_CELL})::bigint, floor(y1 / {_CELL})::bigint)) as h(cy)),
placed as (select c.cx, c.cy, arg_min(s.country, ((c.cx - s.cx) ** 2 + (c.cy - s.cy) ** 2, s.country)) as country from cells c cross join sites s group by 1, 2)"""


@query(f"with {_MAP} select cx, cy, country from placed")
def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole box, with water around the land."""
    return _map_cells(spark, sf_dir)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(_map_cells(spark, sf_dir).filter(F.col("country") != _WATER))


@query(f"""with recursive {_MAP}, land as (select *, (cx + (1 << 30)) * (1::bigint << 31) + cy + (1 << 30) as id from placed where country <> {_WATER}),
sides as (select a.id as a, b.id as b from land a join land b on a.country = b.country and abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
low(id, region) using key (id) as (select id, id from land union select s.b, min(l.region) from low l join sides s on l.id = s.a join recurring.low r on r.id = s.b where l.region < r.region group by s.b)
select cx, cy, country, region from land join low using (id)""")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8."""
    return _regions(spark, sf_dir)


@query()
def country_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed outlines as GeoJSON features."""
    rings = S.outlines(S.borders(_regions(spark, sf_dir), _CELL))
    names = vectors(spark, sf_dir).select("country").distinct().select("country", F.concat(F.lit("country "), "country").alias("label"))
    return geojson(S.multipolygons(rings), names)


_LAND = f"land as (select cx, cy, country from placed where country <> {_WATER})"


@query(f"""with {_MAP}, {_LAND}, edges as (select cx, cy, country, s[1] as i, s[2] as j, cx + s[3] as x1, cy + s[4] as y1, cx + s[5] as x2, cy + s[6] as y2
  from land, unnest([[0, -1, 0, 0, 1, 0], [1, 0, 1, 0, 1, 1], [0, 1, 1, 1, 0, 1], [-1, 0, 0, 1, 0, 0]]) as t(s))
select e.country, count(*) as edges, round(sum(x1 * {_CELL}::double), 3) as x1, round(sum(y1 * {_CELL}::double), 3) as y1, round(sum(x2 * {_CELL}::double), 3) as x2, round(sum(y2 * {_CELL}::double), 3) as y2
from edges e left join land o on o.cx = e.cx + i and o.cy = e.cy + j where o.country is distinct from e.country group by 1""")
def border_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border segments, summed up by country."""
    edges = S.borders(_regions(spark, sf_dir), _CELL)
    return edges.groupBy("country").agg(F.count("*").alias("edges"), *(F.round(F.sum(c), 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"""with {_MAP}, {_LAND}, around as (select l.cx + s[1] as cx, l.cy + s[2] as cy from land l, unnest([[0, -1], [1, 0], [0, 1], [-1, 0]]) as t(s)),
outside as (select distinct cx, cy from around anti join land using (cx, cy)), far as (select l.cx, l.cy, l.country, min(abs(l.cx - o.cx) + abs(l.cy - o.cy)) as level from land l cross join outside o group by all)
select cx, cy, round(level * 0.1::double, 6) as height, 'hsl(' || floor(country * 360 / 10)::int || ', 60%, ' || least(85, floor(35 + level * 0.1::double * 50)::int) || '%)' as colour from far""")
def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5, G11."""
    high = S.elevation(_map_cells(spark, sf_dir).filter(F.col("country") != _WATER))
    return high.select("cx", "cy", r6("height").alias("height"), S.palette(F.col("height"), F.col("country"), 10).alias("colour"))


#: The grid on which the exact graph has its points.
_GRAIN = 2.0**-20


@query(f"""with p as (select vec_id as id, label as country, round(embedding[1]::double * 100 / {_GRAIN}) * {_GRAIN} as x, round(embedding[2]::double * 100 / {_GRAIN}) * {_GRAIN} as y from embeddings),
b as (select min(x) - 10 as x0, max(x) + 10 as x1, min(y) - 10 as y0, max(y) + 10 as y1 from p),
m as (select a.id as a, b.id as b, a.country is distinct from b.country as is_border, (a.x + b.x) / 2 as mx, (a.y + b.y) / 2 as my, a.y - b.y as dx, b.x - a.x as dy, a.x as ax, a.y as ay from p a join p b on a.id < b.id),
halves as (select m.a, m.b, 2 * (c.x - ax) * dx + 2 * (c.y - ay) * dy as k, c.x ** 2 + c.y ** 2 - ax ** 2 - ay ** 2 - 2 * (c.x - ax) * mx - 2 * (c.y - ay) * my as r from m join p c on c.id <> m.a and c.id <> m.b
  union all select a, b, dx, x1 - mx from m cross join b union all select a, b, -dx, mx - x0 from m cross join b union all select a, b, dy, y1 - my from m cross join b union all select a, b, -dy, my - y0 from m cross join b),
span as (select a, b, max(r / k) filter (where k < 0) as low, min(r / k) filter (where k > 0) as high, bool_or(k = 0 and r < 0) as none from halves group by a, b)
select a, b, is_border, round((high - low) * sqrt(dx ** 2 + dy ** 2), 4) as length from span join m using (a, b) where not none and high - low > 1e-9""")
def voronoi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which centres are neighbours, and how long a border they share."""
    _, corners, edges = voronoi.voronoi_graph(_points(spark, sf_dir), margin=10.0, grain=_GRAIN)
    ends = {c: corners.select(F.col("corner").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")) for c in "vw"}
    dx, dy = F.col("xv") - F.col("xw"), F.col("yv") - F.col("yw")
    return edges.join(ends["v"], "v").join(ends["w"], "w").select("a", "b", "is_border", F.round(F.sqrt(dx * dx + dy * dy), 4).alias("length"))


@query()
def voronoi_relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of all centres, those of the water too, whose ids are below 0."""
    points = _points(spark, sf_dir)
    sea = S.with_water(points.limit(0), S.bounding_box(points), _WATER, share=0.0)
    number = -F.pmod(F.xxhash64("x", "y"), F.lit(1 << 62)) - 1
    centres, _, edges = voronoi.voronoi_graph(points.unionByName(sea.withColumn("id", number)), margin=10.0, grain=_GRAIN)
    _, heights = voronoi.relief(centres, edges, _WATER)
    return centres.join(heights, "id").select("id", "country", "is_border", r6("elevation").alias("elevation"))


@query()
def random_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The random fifth."""
    points = _points(spark, sf_dir)
    return S.random_water(points, S.bounding_box(points)).select(r6("x").alias("x"), r6("y").alias("y"))


@query(f"with {_V}, {_LAYOUT_KNN.format(k=3)} select k.id, k.other, round({_euclid('a.e', 'b.e')}, 6) as distance from k join v a on a.id = k.id join v b on b.id = k.other")
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true distance of the three nearest in the plane."""
    v = vectors(spark, sf_dir)
    near = nearest_in_plane(v, 3).select("id", "other")
    own, far = v.select("id", F.col("vector").alias("a")), v.select(F.col("id").alias("other"), F.col("vector").alias("b"))
    return near.join(own, "id").join(far, "other").select("id", "other", r6(euclidean("a", "b")).alias("distance"))


@query()
def kmeans_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8."""
    return C.kmeans_euclidean(vectors(spark, sf_dir), 10).withColumn("distance", r6("distance"))


@query()
def pca_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane of the largest variances, where layouts start."""
    return C.pca_layout(vectors(spark, sf_dir)).select("article_id", r6("x").alias("x"), r6("y").alias("y"))


@query()
def neighbour_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the countries as targets."""
    v = vectors(spark, sf_dir)
    found = neighbour_embedding(v, groups=v.select("article_id", "country"))
    return found.select("article_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query()
def tsne_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cosine distance, perplexity 30."""
    found = tsne.layout(vectors(spark, sf_dir), perplexity=30, still=0.02)
    return found.select("article_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("divergence", 3).alias("divergence"))


@query(f"""with {_V}, d as (select a.id, b.id as other, {_cos('a.e', 'b.e')} as d from v a join v b on a.id <> b.id),
k as (select *, row_number() over (partition by id order by round(d, 12), other) as place from d) select id, other, round(d, 6) as distance, place::int as place from k where place <= 10""")
def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, J15 in all dimensions: the neighbour graph that the layouts start from."""
    return nearest_graph(vectors(spark, sf_dir), 10, "cosine").select("id", "other", r6("distance").alias("distance"), "place")


@query()
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2-G4, G8 over the plane of the largest variances instead of the first two dimensions, with random water."""
    v = vectors(spark, sf_dir)
    plane = C.pca_layout(v).select("article_id", (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"))
    points = plane.join(v.select("article_id", "country"), "article_id")
    box = S.bounding_box(points)
    cells = S.voronoi_cells(S.with_water(points, box, _WATER), _CELL, box)
    return S.regions(cells.filter(F.col("country") != _WATER))


@query(f"with {_V} select id, i::int as pos, round(1000 * e[i] / sqrt({_DOT.format('e', 'e')}), 6) as value from v, unnest(generate_series(1, len(e))) as g(i)")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of norm 1000."""
    rows = vectors(spark, sf_dir).select("id", F.posexplode(F.transform(l2_normalised("vector"), lambda x: x * 1000)).alias("p", "value"))
    return rows.select("id", (F.col("p") + 1).alias("pos"), r6("value").alias("value"))
