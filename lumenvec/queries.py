"""The engine's queries over the driver's tables, each with equivalent SQL.

Records are embeddings with the metadata of the documents of the same ids, a category by label, and a year. Numbers are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .functions.hashing import shard_of
from .functions.predicates import all_of, fields_of
from .lang.parser import parse
from .operators import clusters, footprint, search, stats
from .plans.compile import Sources, compiled
from .plans.nodes import BiasFilter
from .plans.planner import Settings, dimension_of, plan
from .session import Engine
from .shared import written
from .sources import store

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BOUNDS = (2015.0, 2018.0, 2021.0, 2024.0)
DIM = 64
NOW = "2024-02-01 00:00:00"


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def records(spark: SparkSession, sf: str) -> DataFrame:
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    own = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("int").alias("label"), F.concat(F.lit("topic"), F.col("label").cast("int")).alias("category"), (F.lit(2015) + F.col("vec_id") % 11).cast("long").alias("year"))
    return own.join(d, F.col("id") == F.col("doc_id"), "left").drop("doc_id")


def vector_of(spark: SparkSession, sf: str, i: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == i).select("embedding").first()[0]]


def literal(q: list[float]) -> str:
    return f"VECTOR({', '.join(map(repr, q))})"


def interactions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").count()
    e = table(spark, sf, "events").select((F.col("event_id") % n).alias("id"), "event_type", "ts")
    return e.groupBy("id").agg(F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"), F.count("*").alias("popularity"), F.max("ts").alias("last_at"))


def sources(spark: SparkSession, sf: str, **more) -> Sources:
    return Sources(**{"records": records(spark, sf), "buckets": {"year": BOUNDS}, "now": F.lit(NOW).cast("timestamp")} | more)


def found(spark: SparkSession, sf: str, clauses: str, settings: Settings | None = None, kind: str = "SIMILARITY", **more) -> DataFrame:
    """A query text from the vector of id 0."""
    engine = Engine(spark, sources(spark, sf, **more), settings or Settings(dim=DIM, alpha=0.0))
    return engine.frame(f"FIND {kind}(vector, {literal(vector_of(spark, sf))}) {clauses}")


def plain(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", r6(F.col("score")).alias("score"), *more)


R_SQL = f"""r as (select e.vec_id as id, e.embedding::double[] as vector, e.label::int as label, 'topic' || e.label::int as category, (2015 + e.vec_id % 11)::bigint as year, d.lang, d.source, d.n_chars
  from embeddings e left join documents d on e.vec_id = d.doc_id), q as (select embedding::double[] as v from embeddings where vec_id = 0)"""
COS = "1 - list_dot_product(vector, (select v from q))"
X_SQL = "x as (select *, unnest(vector) as v, generate_subscripts(vector, 1) - 1 as d from r), qx as (select unnest(v) as qv, generate_subscripts(v, 1) - 1 as d from q)"


def top_sql(where: str = "true", k: int = 10, offset: int = 0, score: str = COS, cols: str = "", order: str = "s, id") -> str:
    return f"with {R_SQL}, t as (select *, {score} as s from r where {where}) select id, round(s, 6) + 0.0 as score{cols} from t order by {order} limit {k} offset {offset}"


# --- scans -------------------------------------------------------------------------------------------------------

Q["ann_cosine_topk"] = lambda s, d: plain(found(s, d, "LIMIT 10"))
SQL["ann_cosine_topk"] = top_sql()
Q["ann_euclidean_topk"] = lambda s, d: plain(found(s, d, "LIMIT 10", metric="euclidean"))
SQL["ann_euclidean_topk"] = top_sql(score="list_distance(vector, (select v from q))")
Q["cosine_full"] = lambda s, d: plain(found(s, d, "LIMIT 10", metric="cosine_full"))
SQL["cosine_full"] = top_sql(score="1 - list_cosine_similarity(vector, (select v from q))")
_YEAR_DIM = dimension_of("year", DIM) + 1
Q["ann_weighted_mask"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE year >= 2019 LIMIT 10", Settings(dim=DIM, alpha=0.0, use_mask=True)))
SQL["ann_weighted_mask"] = top_sql("year >= 2019", score=f"1 - (list_dot_product(vector, (select v from q)) - 0.75 * vector[{_YEAR_DIM}] * (select v[{_YEAR_DIM}] from q))")
Q["limit_offset"] = lambda s, d: plain(found(s, d, "LIMIT 60 OFFSET 70"))
SQL["limit_offset"] = top_sql(k=60, offset=70)
Q["order_by_score_desc"] = lambda s, d: plain(found(s, d, "ORDER BY score() DESC LIMIT 10"))
SQL["order_by_score_desc"] = f"with {R_SQL}, t as (select id, {COS} as s from r order by s, id limit 50) select id, round(s, 6) + 0.0 as score from t order by s desc, id limit 10"
Q["find_text_source"] = lambda s, d: plain(_text_engine(s, d).frame("FIND SIMILARITY(vector, 'quantum computing') LIMIT 10"))
SQL["find_text_source"] = f"""with {R_SQL}, h as (select sha256('quantum computing') as x), b as (select list_transform(range(32), lambda i: ('0x' || substr(x, 1 + 2 * i, 2))::int::double) as b from h),
u as (select list_transform(b, lambda y: y / sqrt(list_dot_product(b, b))) as u from b), t as (select id, 1 - list_dot_product(vector[1:32], (select u from u)) as s from r) select id, round(s, 6) + 0.0 as score from t order by s, id limit 10"""


def _text_engine(s: SparkSession, d: str) -> Engine:
    from .sources.embedding import HashEmbedder

    src = sources(s, d)
    src.records = src.records.withColumn("vector", F.slice("vector", 1, 32))  # the deterministic embedding has 32 numbers at most
    return Engine(s, src, Settings(dim=32, alpha=0.0), HashEmbedder(32))


Q["point_get"] = lambda s, d: search.get(records(s, d), 7).select("id", "category", "year", "lang")
SQL["point_get"] = f"with {R_SQL} select id, category, year, lang from r where id = 7"
Q["batch_get"] = lambda s, d: search.get_many(records(s, d), table(s, d, "labels").select(F.col("doc_id").alias("id"))).select("id", "category", "n_chars")
SQL["batch_get"] = f"with {R_SQL} select id, category, n_chars from r where id in (select doc_id from labels)"
Q["l2_normalize"] = lambda s, d: records(s, d).select("id", V.normalized(F.transform(V.doubles(F.col("vector")), lambda x: x * 3)).alias("n")).select("id", r6(F.col("n")[0]).alias("first"), r6(F.col("n")[63]).alias("last"), r6(V.norm(F.col("n"))).alias("norm"))
SQL["l2_normalize"] = f"with {R_SQL}, n as (select id, list_transform(vector, lambda x: x * 3) as w from r), m as (select id, sqrt(list_dot_product(w, w)) as l, w from n) select id, round(w[1] / l, 6) + 0.0 as first, round(w[64] / l, 6) + 0.0 as last, round(sqrt(list_sum(list_transform(w, lambda x: (x / l) * (x / l)))), 6) + 0.0 as norm from m"
Q["vector_project_mask"] = lambda s, d: records(s, d).select("id", V.projected(F.col("vector"), {0: 2.0, 2: 0.5}, DIM).alias("p")).select("id", *[r6(F.col("p")[k]).alias(f"p{k}") for k in range(4)])
SQL["vector_project_mask"] = f"with {R_SQL} select id, round(vector[1] * 2, 6) + 0.0 as p0, round(vector[2], 6) + 0.0 as p1, round(vector[3] * 0.5, 6) + 0.0 as p2, round(vector[4], 6) + 0.0 as p3 from r"

# --- filters -----------------------------------------------------------------------------------------------------

_WHERE = {
    "where_eq_string": ("category = 'topic0'", "category = 'topic0'"),
    "where_neq": ("category != 'topic0'", "category != 'topic0'"),
    "where_range": ("year >= 2020", "year >= 2020"),
    "where_range_float": ("year < 2017.5", "year < 2017.5"),
    "where_in": ("category IN ('topic2', 'topic8', 'topic6')", "category in ('topic2', 'topic8', 'topic6')"),
    "where_in_numbers": ("year IN (2016, 2018.0)", "year in (2016, 2018)"),
    "where_between": ("year BETWEEN 2017 AND 2019", "year between 2017 and 2019"),
    "where_like_prefix": ("source LIKE 'src1%'", "starts_with(source, 'src1')"),
    "where_like_suffix": ("source LIKE '%3'", "source like '%3'"),
    "where_like_contains": ("category LIKE '%pic1%'", "contains(category, 'pic1')"),
    "where_and": ("category = 'topic3' AND year >= 2018 AND lang != 'en'", "category = 'topic3' and year >= 2018 and lang != 'en'"),
    "where_missing_field": ("nowhere != 'x'", "false"),
    "where_null_field": ("lang != 'en'", "lang != 'en'"),
    "where_string_order": ("lang > 'en'", "lang > 'en'"),
    "where_type_mismatch": ("year = '2020'", "false"),
}
for _name, (_find, _sql) in _WHERE.items():
    Q[_name] = lambda s, d, w=_find: plain(found(s, d, f"WITH METADATA WHERE {w} PROJECT ON category, year LIMIT 20"), "category", "year")
    SQL[_name] = top_sql(_sql, 20, cols=", category, year")
Q["prefilter_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE year >= 2024 LIMIT 10"))
SQL["prefilter_topk"] = top_sql("year >= 2024")
Q["postfilter_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE year >= 2024 LIMIT 10", Settings(dim=DIM, alpha=0.0, filter_after=True)))
SQL["postfilter_topk"] = f"with {R_SQL}, t as (select id, year, {COS} as s from r order by s, id limit 50) select id, round(s, 6) + 0.0 as score from t where year >= 2024 order by s, id limit 10"
Q["project_fields"] = lambda s, d: plain(found(s, d, "PROJECT ON category AS c, upper(lang), year LIMIT 15"), "c", "upper_lang", "year")
SQL["project_fields"] = top_sql(k=15, cols=", category as c, upper(lang) as upper_lang, year")


@query("where_json_prop", "select event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as total from events where json_type(props, '$.k') in ('UBIGINT', 'BIGINT') and (props->>'$.k')::bigint between 10 and 60 and (props->>'$.k')::bigint != 30 group by event_type")
def _json(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    where = parse("FIND SIMILARITY(v, '') WITH METADATA WHERE k BETWEEN 10 AND 60 AND k != 30").where
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return e.where(all_of(where, fields_of(e, "props"))).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


# --- statistics --------------------------------------------------------------------------------------------------

Q["global_centroid"] = lambda s, d: stats.global_centroid(records(s, d)).select(F.col("d").cast("long").alias("d"), r6(F.col("c")).alias("c"))
SQL["global_centroid"] = f"with {R_SQL}, {X_SQL} select d::bigint as d, round(avg(v), 6) + 0.0 as c from x group by d"
Q["category_centroid"] = lambda s, d: stats.centroids(stats.sums(records(s, d), "category")).select("value", F.col("d").cast("long").alias("d"), r6(F.col("c")).alias("c"))
SQL["category_centroid"] = f"with {R_SQL}, {X_SQL} select category as value, d::bigint as d, round(avg(v), 6) + 0.0 as c from x group by category, d"
Q["category_delta"] = lambda s, d: stats.category_deltas(records(s, d), "category").select("value", F.col("d").cast("long").alias("d"), r6(F.col("delta")).alias("delta"))
SQL["category_delta"] = f"with {R_SQL}, {X_SQL}, g as (select d, avg(v) as g from x group by d) select category as value, d::bigint as d, round(avg(v) - any_value(g), 6) + 0.0 as delta from x join g using (d) group by category, d"
_BUCKET = f"greatest(0, len(list_filter({list(BOUNDS)}, lambda b: b <= year)) - 1)"
Q["bucket_assign"] = lambda s, d: records(s, d).select("id", "year", stats.bucket_of(F.col("year"), BOUNDS).cast("int").alias("bucket"))
SQL["bucket_assign"] = f"with {R_SQL} select id, year, {_BUCKET}::int as bucket from r"
Q["bucket_centroid"] = lambda s, d: stats.centroids(stats.bucket_sums(records(s, d), "year", BOUNDS)).select(F.col("value").cast("int").alias("bucket"), F.col("d").cast("long").alias("d"), r6(F.col("c")).alias("c"))
SQL["bucket_centroid"] = f"with {R_SQL}, {X_SQL} select {_BUCKET}::int as bucket, d::bigint as d, round(avg(v), 6) + 0.0 as c from x group by 1, 2"
_DELTA_SQL = f"b as (select {_BUCKET} as bucket, d, avg(v) as c from x group by 1, 2), g as (select d, avg(v) as g from x where year is not null group by d), bd as (select bucket, b.d, c - g as delta from b join g using (d))"
for _name, _f, _range in (("gte", BiasFilter("year", 2020.0, ">="), (1, 3)), ("lte", BiasFilter("year", 2020.0, "<="), (0, 1)), ("eq", BiasFilter("year", 2020.0, "="), (1, 1)), ("range", BiasFilter("year", 2019.0, "range", 2023.9), (1, 2))):
    Q[f"bucket_delta_{_name}"] = lambda s, d, f=_f: stats.bucket_delta(stats.bucket_sums(records(s, d), "year", BOUNDS), f, BOUNDS).select(F.col("d").cast("long").alias("d"), r6(F.col("delta")).alias("delta"))
    SQL[f"bucket_delta_{_name}"] = f"with {R_SQL}, {X_SQL}, {_DELTA_SQL} select d::bigint as d, round(avg(delta), 6) + 0.0 as delta from bd where bucket between {_range[0]} and {_range[1]} group by d"
Q["pearson_by_dim"] = lambda s, d: stats.correlations(records(s, d), "n_chars").select(F.col("d").cast("long").alias("d"), r6(F.col("r")).alias("r"), r6(F.col("mean")).alias("mean"))
_CORR = "coalesce(covar_pop(n_chars::double, v) / nullif(stddev_pop(n_chars::double) * stddev_pop(v), 0), 0)"
SQL["pearson_by_dim"] = f"with {R_SQL}, {X_SQL} select d::bigint as d, round({_CORR}, 6) + 0.0 as r, round(avg(n_chars::double), 6) + 0.0 as mean from x where n_chars is not null group by d"
Q["field_mean"] = lambda s, d: stats.field_mean(records(s, d), "n_chars").select(r6(F.col("mean")).alias("mean"))
SQL["field_mean"] = f"with {R_SQL} select round(avg(n_chars::double), 6) + 0.0 as mean from r"
Q["selectivity"] = lambda s, d: stats.selectivity(records(s, d), (F.col("category") == "topic0") & (F.col("year") >= 2020)).select(r6(F.col("selectivity")).alias("selectivity"))
SQL["selectivity"] = f"with {R_SQL} select round(avg(case when category = 'topic0' and year >= 2020 then 1.0 else 0.0 end::double), 6) + 0.0 as selectivity from r"

# --- biased searches ---------------------------------------------------------------------------------------------

_ALPHA = 0.3
_CAT_SHIFT = f"select d, {_ALPHA} * ((avg(v) filter (where category = 'topic0')) - avg(v)) as shift from x group by d"
_BUCKET_SHIFT = f"select d, {_ALPHA} * avg(delta) as shift from bd where bucket between 1 and 3 group by d"
_CORR_SHIFT = f"select d, {_ALPHA} * {_CORR} * (1000.0 - avg(n_chars::double)) as shift from x where n_chars is not null group by d"


def _biased_sql(shifts: str, where: str, k: int = 10) -> str:
    return f"""with {R_SQL}, {X_SQL}, {_DELTA_SQL}, sh as (select d, sum(shift) as shift from ({shifts}) group by d), qb as (select qx.d, qv + coalesce(shift, 0) as qv from qx left join sh using (d)),
t as (select id, 1 - sum(v * qv) as s from x join qb using (d) where {where} group by id) select id, round(s, 6) + 0.0 as score from t order by s, id limit {k}"""


_BIASED = Settings(dim=DIM, alpha=_ALPHA)
Q["bias_category_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE category = 'topic0' LIMIT 10", _BIASED))
SQL["bias_category_topk"] = _biased_sql(_CAT_SHIFT, "category = 'topic0'")
Q["bias_bucket_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE year >= 2020 LIMIT 10", _BIASED))
SQL["bias_bucket_topk"] = _biased_sql(_BUCKET_SHIFT, "year >= 2020")
Q["bias_correlation_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE n_chars >= 1000 LIMIT 10", _BIASED))
SQL["bias_correlation_topk"] = _biased_sql(_CORR_SHIFT, "n_chars >= 1000")
Q["bias_combined_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE category = 'topic0' AND year >= 2020 LIMIT 10", _BIASED))
SQL["bias_combined_topk"] = _biased_sql(f"{_CAT_SHIFT} union all {_BUCKET_SHIFT}", "category = 'topic0' and year >= 2020")
Q["budget_bias_topk"] = lambda s, d: plain(found(s, d, "WITH METADATA WHERE category = 'topic0' WITHIN 50ms", Settings(dim=DIM, alpha=2 * _ALPHA, records=1000, cost_per_distance_ms=1e-5)))
SQL["budget_bias_topk"] = _biased_sql(_CAT_SHIFT, "category = 'topic0'")



@query(
    "recall_at_10",
    f"""with {R_SQL}, {X_SQL}, sh as ({_CAT_SHIFT}), qb as (select qx.d, qv, qv + coalesce(shift, 0) as qs from qx left join sh using (d)),
e as (select id, 1 - sum(v * qv) as s from x join qb using (d) where category = 'topic0' group by id order by s, id limit 10),
c as (select id, category, 1 - sum(v * qs) as s from x join qb using (d) group by id, category order by s, id limit 100), f as (select id from c where category = 'topic0' order by s, id limit 10)
select round(count(*) / 10.0, 6)::double + 0.0 as recall from e where id in (select id from f)""",
)
def _recall(s: SparkSession, d: str) -> DataFrame:
    exact = found(s, d, "WITH METADATA WHERE category = 'topic0' LIMIT 10")
    late = found(s, d, "WITH METADATA WHERE category = 'topic0' LIMIT 10", Settings(dim=DIM, alpha=_ALPHA, filter_after=True, candidates=100))
    return search.recall(late, exact, 10).select(r6(F.col("recall")).alias("recall"))


_INTERACTIONS = "i as (select event_id % (select count(*) from embeddings) as id, count(*) filter (where event_type = 'click') as clicks, count(*) as popularity, max(ts) as last_at from events group by 1)"


def _rescored_sql(factor: str, order: str = "desc") -> str:
    return f"with {R_SQL}, {_INTERACTIONS}, c as (select id, {COS} as s from r order by s, id limit 50), t as (select c.id, s, (1 - s) * {factor} as rs from c left join i on c.id = i.id) select id, round(s, 6) + 0.0 as score, round(rs, 6) + 0.0 as rank_score from t order by rs {order}, id limit 10"


for _name, _clause, _factor in (
    ("bias_recency", "BIAS recency()", f"coalesce(exp(-((epoch_us(timestamp '{NOW}') // 1000000 - epoch_us(last_at) // 1000000) / 86400.0) / 30.0), 0)"),
    ("bias_popularity", "BIAS popularity()", "(1 + ln(1 + coalesce(popularity, 0)))"),
    ("bias_clicks", "BIAS relevance_clicks(current_user)", "(1 + ln(1 + coalesce(clicks, 0)))"),
    ("order_by_clicks", "ORDER BY relevance_clicks(current_user) DESC", "(1 + ln(1 + coalesce(clicks, 0)))"),
):
    Q[_name] = lambda s, d, c=_clause: plain(found(s, d, f"{c} LIMIT 10", interactions=interactions(s, d)), r6(F.col("rank_score")).alias("rank_score"))
    SQL[_name] = _rescored_sql(_factor)


def _clicks(s: SparkSession, d: str) -> DataFrame:
    e, vec = table(s, d, "events").where("event_type = 'click'"), table(s, d, "embeddings")
    n = vec.count()
    ids = e.select("user_id", F.struct("ts", "event_id").alias("at"), (F.col("event_id") % n).alias("item"), (F.col("user_id") % n).alias("asked"))
    return ids.join(vec.select(F.col("vec_id").alias("item"), F.col("embedding").alias("click")), "item").join(vec.select(F.col("vec_id").alias("asked"), F.col("embedding").alias("query")), "asked")


_FOOT_SQL = """n as (select count(*) as n from embeddings), k as (select user_id, row_number() over w as i, count(*) over (partition by user_id) as m, event_id % n as item, user_id % n as asked from events, n where event_type = 'click' window w as (partition by user_id order by ts, event_id)),
kx as (select user_id, i, m, generate_subscripts(c.embedding, 1) - 1 as d, unnest(c.embedding)::double as c, unnest(a.embedding)::double as a from k join embeddings c on c.vec_id = item join embeddings a on a.vec_id = asked),
fp as (select user_id, d, any_value(m) as m, sum(case when i = 1 then pow(0.7, m) * c else 0 end + 0.3 * pow(0.7, m - i) * c * a) as f from kx group by user_id, d)"""


@query("personal_footprint", f"with {_FOOT_SQL} select user_id, any_value(m) as n, round(sum(case when d = 0 then f else 0 end), 6) + 0.0 as first, round(sqrt(sum(f * f)), 6) + 0.0 as norm from fp group by user_id")
def _footprints(s: SparkSession, d: str) -> DataFrame:
    return footprint.footprints(_clicks(s, d), at="at").select("user_id", "n", r6(F.col("footprint")[0]).alias("first"), r6(V.norm(F.col("footprint"))).alias("norm"))


@query("find_personal", f"with {R_SQL}, {X_SQL}, {_FOOT_SQL}, u as (select min(user_id) as u from fp), t as (select id, 1 - sum(v * qv * f) as s from x join qx using (d) join fp using (d) where user_id = (select u from u) group by id) select id, round(s, 6) + 0.0 as score from t order by s, id limit 10")
def _personal(s: SparkSession, d: str) -> DataFrame:
    prints = footprint.footprints(_clicks(s, d), at="at")
    user = prints.agg(F.min("user_id")).first()[0]
    engine = Engine(s, sources(s, d), Settings(dim=DIM, alpha=0.0), footprints=prints)
    return plain(engine.frame(f"FIND SEMANTIC(vector, {literal(vector_of(s, d))}) LIMIT 10", user=user))


# --- tiers, changes, shards, clusters ----------------------------------------------------------------------------


@query("hybrid_merge", f"with {R_SQL}, h as (select id, vector from r), t as (select id, min({COS}) as s from h group by id) select id, round(s, 6) + 0.0 as score from t order by s, id limit 20")
def _hybrid(s: SparkSession, d: str) -> DataFrame:
    r = records(s, d)
    stale = r.withColumn("vector", F.when(F.col("id") % 10 < 2, F.transform(V.doubles(F.col("vector")), lambda x: x * 1.5)).otherwise(V.doubles(F.col("vector"))))
    src = sources(s, d, records=stale, hot=r.where(F.col("id") % 10 < 2).withColumn("vector", V.doubles(F.col("vector"))))
    return plain(compiled(plan(parse("FIND SIMILARITY(vector, '') LIMIT 20"), Settings(dim=DIM, alpha=0.0, merge=True)), src, vector_of(s, d)))


Q["merge_descending"] = lambda s, d: _merged(s, d)
SQL["merge_descending"] = f"with {R_SQL}, t as (select id, max(v) as s from (select id, list_dot_product(vector, (select v from q)) as v from r union all select id, 0.5 as v from r where id % 7 = 0) group by id) select id, round(s, 6) + 0.0 as score from t order by round(s, 9) desc, id limit 15"


def _merged(s: SparkSession, d: str) -> DataFrame:
    r = records(s, d)
    one = r.select("id", F.round(V.dot(F.col("vector"), V.literal(vector_of(s, d))), 9).alias("score"))
    return plain(search.merge(one, r.where("id % 7 = 0").select("id", F.lit(0.5).alias("score")), k=15, descending=True))


Q["tombstone_antijoin"] = lambda s, d: plain(found(s, d, "LIMIT 20", deleted=records(s, d).where("id % 17 = 0").select("id")))
SQL["tombstone_antijoin"] = top_sql("id % 17 <> 0", 20)
_LOG = "l as (select event_id as txn_id, user_id as id, case when event_type = 'error' then 'delete' else 'insert' end as op, value from events)"


def _log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), "value")


Q["upsert_latest"] = lambda s, d: store.replayed(_log(s, d), 100).select("id", "txn_id", "value")
SQL["upsert_latest"] = f"with {_LOG}, t as (select id, max(txn_id) as txn_id, arg_max(op, txn_id) as op, arg_max(value, txn_id) as value from l where txn_id > 100 group by id) select id, txn_id, value from t where op <> 'delete'"
Q["log_compact"] = lambda s, d: search.compacted(_log(s, d).unionByName(_log(s, d).where("txn_id % 3 = 0")), 50).groupBy("op").agg(F.count("*").alias("n"), F.sum("txn_id").alias("total"))
SQL["log_compact"] = f"with {_LOG} select op, count(*) as n, sum(txn_id)::bigint as total from l where txn_id > 50 group by op"
Q["evict_least_accessed"] = lambda s, d: search.coldest(records(s, d).join(interactions(s, d).select("id", F.col("popularity").alias("access_count")), "id"), 25)[0].select("id", "access_count")
SQL["evict_least_accessed"] = f"with {R_SQL}, {_INTERACTIONS} select r.id, popularity as access_count from r join i on r.id = i.id order by 2, 1 limit 25"
Q["partition_centroid"] = lambda s, d: search.partition_centroids(records(s, d), "year").select("year", F.col("d").cast("long").alias("d"), r6(F.col("c")).alias("c"), "n")
SQL["partition_centroid"] = f"with {R_SQL}, {X_SQL} select year, d::bigint as d, round(avg(v), 6) + 0.0 as c, count(*) as n from x group by year, d"
Q["wake_partitions"] = lambda s, d: search.nearby_partitions(search.partition_centroids(records(s, d), "year"), s.createDataFrame([(vector_of(s, d),)], "q array<double>"), "year", 1.0).select("year", r6(F.col("distance")).alias("distance"))
SQL["wake_partitions"] = f"with {R_SQL}, {X_SQL}, c as (select year, d, avg(v) as c from x group by year, d), t as (select year, sqrt(sum((c - qv) * (c - qv))) as s from c join qx using (d) group by year) select year, round(s, 6) + 0.0 as distance from t where s < 1.0"
_JUMP = "j(id, key, b, j) as (select vec_id, vec_id::hugeint, -1::bigint, 0::bigint from embeddings union all select id, k2, j, floor((j + 1) * (2147483648.0::double / ((k2 // 8589934592) + 1)::double))::bigint from (select id, (key * 2862933555777941757 + 1) % 18446744073709551616 as k2, j from j where j < 64)), sh as (select id, b::int as shard from j where j >= 64)"
Q["shard_assign"] = lambda s, d: records(s, d).select("id", shard_of(F.col("id")).alias("shard"))
SQL["shard_assign"] = f"with recursive {_JUMP} select id, shard from sh"
for _name, _shards in (("shard_topk_merge", None), ("shard_topk_partial", range(0, 64, 2))):  # all shards; half of them answer, which the result says
    Q[_name] = lambda s, d, a=_shards: plain(search.shard_top_k(records(s, d), V.literal(vector_of(s, d)), 10, available=a), "shard", "total", "responded", "partial")
    _told = "64 as total, 64 as responded, false as partial" if _shards is None else "64 as total, 32 as responded, true as partial"
    SQL[_name] = f"with recursive {_JUMP}, {R_SQL}, t as (select id, shard, {COS} as s from r join sh using (id){'' if _shards is None else ' where shard % 2 = 0'}) select id, round(s, 6) + 0.0 as score, shard, {_told} from t order by s, id limit 10"
_SEEDS = "k as (select id as cluster_id, vector as centroid from r where id % 50 = 0)"
_ASSIGN = f"{_SEEDS}, a as (select r.id, vector, arg_min(cluster_id, (round(1 - list_cosine_similarity(vector, centroid), 12), cluster_id)) as cluster_id from r, k where r.id % 50 <> 0 group by r.id, vector)"


def _seeded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = records(s, d)
    seeds = clusters.started(r.where("id % 50 = 0"))
    return seeds, clusters.assign(r.where("id % 50 <> 0"), seeds)


Q["nearest_centroid_assign"] = lambda s, d: _seeded(s, d)[1].select("id", "cluster_id")
SQL["nearest_centroid_assign"] = f"with {R_SQL}, {_ASSIGN} select id, cluster_id from a"
Q["centroid_update"] = lambda s, d: clusters.updated(*_seeded(s, d)).select("cluster_id", "n", F.posexplode("centroid").alias("d", "c")).select("cluster_id", "n", F.col("d").cast("long").alias("d"), r6(F.col("c")).alias("c"))
SQL["centroid_update"] = f"with {R_SQL}, {_ASSIGN}, m as (select cluster_id, centroid as v from k union all select cluster_id, vector as v from a), mx as (select cluster_id, unnest(v) as v, generate_subscripts(v, 1) - 1 as d from m) select cluster_id, count(*) as n, d::bigint as d, round(avg(v), 6) + 0.0 as c from mx group by cluster_id, d"


def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Records with cluster_id, kept, and their clusters with radius."""
    r = records(s, d)
    c = clusters.trained(s, r, 10)
    assigned = written(clusters.assign(r, c), "assigned")
    return assigned, written(clusters.with_radius(c, assigned), "clusters")


Q["cluster_probe_safe_topk"] = lambda s, d: plain(clusters.probe_safe(*_index(s, d), vector_of(s, d), 10))
SQL["cluster_probe_safe_topk"] = top_sql()
Q["knn_join_hundredth"] = lambda s, d: search.knn_join(records(s, d).where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q")), records(s, d), 5).select("qid", "id", r6(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))
SQL["knn_join_hundredth"] = "with t as (select a.vec_id as qid, b.vec_id as id, 1 - list_dot_product(a.embedding::double[], b.embedding::double[]) as s from embeddings a, embeddings b where a.vec_id % 100 = 0), n as (select *, row_number() over (partition by qid order by round(s, 9), id) as rank from t) select qid, id, round(s, 6) + 0.0 as score, rank from n where rank <= 5"


@query("rate_windows", "select epoch_us(ts) // 60000000 as minute, user_id, count(*) as n from events group by 1, 2 having count(*) > 1")
def _windows(s: SparkSession, d: str) -> DataFrame:
    from .streaming.ingest import windowed_counts

    w = windowed_counts(table(s, d, "events"))
    return w.where("n > 1").select(F.floor(F.unix_timestamp("window.start") / 60).cast("long").alias("minute"), "user_id", "n")


def flagship(s: SparkSession, d: str) -> DataFrame:
    return plain(found(s, d, "PROJECT ON category, year WITH METADATA WHERE year >= 2018 LIMIT 10", _BIASED), "category", "year")
