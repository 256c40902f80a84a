"""Similarity, evaluation, sampling, feature and event queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinolith.functions import arrays, maths, text
from kinolith.operators import assembly, features, metrics, sampling, score, similarity
from kinolith.plans.base import query, table
from kinolith.streaming import quota

_QUERIES_SQL = """v as (select vec_id, list_transform(embedding, lambda x: x::double) as e, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings),
hits as (select q.vec_id as query, round(greatest(0.0, 100 * list_inner_product(q.e, t.e) / (q.norm * t.norm)), 6) as score from v q join v t on q.vec_id % 50 = 0 and q.vec_id <> t.vec_id),
best as (select query, max(score) as best, round(avg(score), 6) as mean from hits group by 1)"""


def _similarity_stats(spark, sf_dir):
    """Every fiftieth vector against all others, in blocks."""
    return similarity.block_statistics(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 50).withColumn("mean", F.round("mean", 6))


@query(f"""with {_QUERIES_SQL}, bins as (select cast(least(100, greatest(0, round_even(best, 0))) as int) as bin, count(*) as n from best group by 1)
select cast(b.bin as int) as bin, coalesce(n, 0) as n, round(coalesce(n, 0) * 100.0::double / (select count(*) from best), 6) as percent from range(101) b(bin) left join bins using (bin)""")
def similarity_histogram(spark, sf_dir):
    histogram = similarity.dense_histogram(_similarity_stats(spark, sf_dir), F.col("best"))
    return histogram.withColumn("percent", F.round("percent", 6))


@query(f"""with {_QUERIES_SQL}, bins as (select cast(least(100, greatest(0, round_even(best, 0))) as int) as b, count(*) as n from best group by 1)
select cast(i as int) as bin, cast((select coalesce(sum(n), 0) from bins where b >= floor(i * 101 / 20) and b < floor((i + 1) * 101 / 20)) as bigint) as n from range(20) t(i)""")
def histogram_rebin(spark, sf_dir):
    return similarity.rebinned(similarity.dense_histogram(_similarity_stats(spark, sf_dir), F.col("best")), 20)


@query(f"""with {_QUERIES_SQL} select round(coalesce(avg(mean), 0.0), 2) as mean_similarity, round(coalesce(avg(best), 0.0), 2) as best_similarity from best""")
def global_similarity(spark, sf_dir):
    return _similarity_stats(spark, sf_dir).agg(
        F.round(F.coalesce(F.avg("mean"), F.lit(0.0)), 2).alias("mean_similarity"), F.round(F.coalesce(F.avg("best"), F.lit(0.0)), 2).alias("best_similarity")
    )


@query("""with f as (select text, length(text) as size from documents group by 1) select doc_id, size from documents join f using (text)""")
def distinct_score_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assembly.on_distinct(docs, "text", lambda d: d.withColumn("size", F.length("text").cast("long"))).select("doc_id", "size")


_METRICS_SQL = """count(*) as n, round(avg(abs(y - p)), 4) as mae, round(sqrt(avg((y - p) * (y - p))), 4) as rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) as r2, round(corr(y, p), 6) as pearson"""


def _rounded(found):
    return found.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "r2": F.round("r2", 6), "pearson": F.round("pearson", 6)})


@query(f"""select l_returnflag, {_METRICS_SQL} from (select l_returnflag, l_extendedprice as y, 1500 * l_quantity as p from lineitem) group by 1""")
def metrics_by_group(spark, sf_dir):
    return _rounded(metrics.regression(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), 1500 * F.col("l_quantity"), ["l_returnflag"]))


@query(f"""with r as (select l_extendedprice as y, 1500 * l_quantity as p, l_orderkey % 10 >= 8 as t, l_quantity > 25 as big from lineitem)
select subset, {_METRICS_SQL} from (select 'all' as subset, y, p from r union all select 'test', y, p from r where t union all select 'train', y, p from r where not t union all select 'big', y, p from r where big union all select 'big_test', y, p from r where big and t) group by 1""")
def metrics_by_subset(spark, sf_dir):
    t, big = F.col("l_orderkey") % 10 >= 8, F.col("l_quantity") > 25
    rows = metrics.tagged(table(spark, sf_dir, "lineitem"), {"all": F.lit(True), "test": t, "train": ~t, "big": big, "big_test": big & t})
    return _rounded(metrics.regression(rows, F.col("l_extendedprice"), 1500 * F.col("l_quantity"), ["subset"]))


@query("""with v as (select label::double as y, list_sort(list_transform(embedding, lambda x: x::double)) as s, list_avg(list_transform(embedding, lambda x: x::double)) as c, list_stddev_pop(list_transform(embedding, lambda x: x::double)) as sd from embeddings),
i as (select y, c, sd, s[1 + floor((len(s) - 1) * 0.05)::int] + ((len(s) - 1) * 0.05 - floor((len(s) - 1) * 0.05)) * (s[1 + ceil((len(s) - 1) * 0.05)::int] - s[1 + floor((len(s) - 1) * 0.05)::int]) as lo,
 s[1 + floor((len(s) - 1) * 0.95)::int] + ((len(s) - 1) * 0.95 - floor((len(s) - 1) * 0.95)) * (s[1 + ceil((len(s) - 1) * 0.95)::int] - s[1 + floor((len(s) - 1) * 0.95)::int]) as hi from v)
select count(*) as n, round(avg((y between lo and hi)::int::double), 6) as coverage, round(avg((y < lo)::int::double), 6) as under, round(avg((y > hi)::int::double), 6) as over, round(avg(hi - lo), 5) as width, round(avg(abs(y - c)), 5) as mae, round(avg((y between lo and hi)::int::double) - 0.9, 6) as gap, round(corr(sd, abs(y - c)), 5) as spread_error_corr,
round(quantile_cont(hi - lo, 0.1), 5) as width_p10, round(quantile_cont(hi - lo, 0.5), 5) as width_median, round(quantile_cont(hi - lo, 0.9), 5) as width_p90, round(avg(hi - lo + (greatest(lo - y, 0) + greatest(y - hi, 0)) * 20), 4) as winkler from i""")
def interval_eval(spark, sf_dir):
    rows = metrics.intervals(table(spark, sf_dir, "embeddings").withColumn("y", F.col("label").cast("double")), "embedding", 0.1)
    found = metrics.interval_quality(rows, "y", 0.1)
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("coverage", "under", "over")], F.round("width", 5).alias("width"), F.round("mae", 5).alias("mae"), F.round("winkler", 4).alias("winkler"), F.round("gap", 6).alias("gap"), *[F.round(c, 5).alias(c) for c in ("spread_error_corr", "width_p10", "width_median", "width_p90")])


@query("""with r as (select o_orderstatus as g, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as r from orders where o_orderstatus in ('F', 'O')),
s as (select sum(r) filter (g = 'F')::double as s, count(*) filter (g = 'F')::double as n1, count(*) filter (g = 'O')::double as n2 from r),
z as (select n1, n2, (s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) as z from s),
i as (select n1, n2, z, sum(case when i in (0, 2000) then 1 when i % 2 = 1 then 4 else 2 end * exp(-0.5 * (z * i / 2000) * (z * i / 2000))) * any_value(abs(z)) / 6000 / sqrt(2 * pi()) as half from z, range(2001) t(i) group by n1, n2, z)
select n1::bigint as n1, n2::bigint as n2, round(z, 5) as z, round(1 - 2 * half, 5) as p from i""")
def rank_sum(spark, sf_dir):
    found = metrics.rank_sum(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return found.select("n1", "n2", F.round("z", 5).alias("z"), F.round("p", 5).alias("p"))


@query("""select left(p_type, 1) as label, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from part group by 1""")
def class_share(spark, sf_dir):
    return metrics.share_by(table(spark, sf_dir, "part"), F.substring("p_type", 1, 1)).withColumn("share", F.round("share", 6))


@query("""select r_name, p_brand, round(median(l_extendedprice), 4) as median_price, count(*) as n from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def star_rollup(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    suppliers = table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    joined = lines.join(parts, "l_partkey").join(suppliers, "l_suppkey")
    medians = assembly.quantiles(joined, ["r_name", "p_brand"], "l_extendedprice", {"median_price": 0.5}, "n")
    return medians.withColumn("median_price", F.round("median_price", 4))


@query("""with b as (select floor(log10(l_extendedprice) / 0.25)::int as bin from lineitem), c as (select bin, count(*) as n from b group by 1)
select bin, n, round(quantile_cont(n, 0.5) over () * 2, 4) as target from c""")
def value_bins(spark, sf_dir):
    bins = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.log10("l_extendedprice") / 0.25).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    target = F.percentile("n", F.lit(0.5)).over(Window.partitionBy()) * 2  # one row per bin
    return bins.select("bin", "n", F.round(target, 4).alias("target"))


_BINS_SQL = """r as (select l_orderkey, l_linenumber, floor(log10(l_extendedprice) / 0.25)::int as bin from lineitem),
c as (select bin, count(*) as n from r group by 1), t as (select floor(quantile_cont(n, 0.5) * 2)::bigint as target from c),
k as (select r.*, n, greatest(n, target) as target, row_number() over (partition by bin order by (l_orderkey * 7919 + 42 * 104729) % 999983, l_orderkey, l_linenumber) - 1 as rank from r join c using (bin), t),
o as (select l_orderkey, l_linenumber, bin, unnest(range(1, target // n + 1 + case when rank < target % n then 1 else 0 end))::int as copy from k)"""


def _binned(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.log10("l_extendedprice") / 0.25).cast("int").alias("bin"))


@query(f"with {_BINS_SQL} select * from o")
def value_bins_oversample(spark, sf_dir):
    return sampling.oversampled(_binned(spark, sf_dir), "bin", ["l_orderkey", "l_linenumber"])


@query(f"with {_BINS_SQL} select bin, any_value(n) as before, (select count(*) from o where o.bin = c.bin) as after from c group by 1")
def band_counts(spark, sf_dir):
    rows = _binned(spark, sf_dir)
    return sampling.band_counts(rows, sampling.oversampled(rows, "bin", ["l_orderkey", "l_linenumber"]), "bin")


@query("""with b as (select floor(log10(o_totalprice) * 4)::int as bin, count(*) as n from orders group by 1), s as (select min(bin) as a, max(bin) as z from b),
f as (select g.bin::int as bin, coalesce(n, 0) as n from (select unnest(range(a, z + 1)) as bin from s) g left join b on g.bin = b.bin)
select bin, n, round(0.5 * lag(n, 1, 0) over (order by bin) + n + 0.5 * lead(n, 1, 0) over (order by bin), 4)::double as smoothed from f""")
def lds_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("bin", maths.unit_bin(F.log10("o_totalprice"), 4))
    return sampling.smoothed_density(rows, "bin").withColumn("smoothed", F.round("smoothed", 4))


@query("""select o_orderkey, ((o_orderkey * 7919 + 42 * 104729) % 999983 % 5)::int as fold, case when ((o_orderkey * 7919 + 1234 * 104729) % 999983) / 999983 < 0.8 then 0 when ((o_orderkey * 7919 + 1234 * 104729) % 999983) / 999983 < 0.8 + 0.1 then 1 else 2 end as part from orders""")
def folds(spark, sf_dir):
    rows = sampling.folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return sampling.split_tags(rows, "o_orderkey")


@query("""with f as (select l_extendedprice as y, l_quantity as x, ((l_orderkey * 7919 + 42 * 104729) % 999983 % 5)::int as fold from lineitem), m as (select fold, sqrt(avg((y - 1500 * x) * (y - 1500 * x))) as rmse from f group by 1)
select round(avg(rmse), 4) as mean, round(stddev_pop(rmse), 4) as sd, count(*) as folds from m""")
def fold_summary(spark, sf_dir):
    rows = sampling.folds(table(spark, sf_dir, "lineitem"), "l_orderkey")
    each = metrics.regression(rows, F.col("l_extendedprice"), 1500 * F.col("l_quantity"), ["fold"])
    return metrics.fold_summary(each, "rmse", []).select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "folds")


@query("""select o_orderkey from orders where o_custkey not in (select o_custkey from orders where ((o_custkey * 7919 + 42 * 104729) % 999983) / 999983 < 0.1)""")
def leakage_safe(spark, sf_dir):
    marked = sampling.holdout_groups(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    test = marked.where("test")
    return sampling.leakage_safe(marked.where("not test"), test, test, "o_custkey").select("o_orderkey")


@query("""select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1""")
def stacking_linear(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("intercept")
    )


@query("""with l as (select label, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as dim from embeddings) select label, dim, round(avg(x), 6) as mean from l group by 1, 2""")
def pooling(spark, sf_dir):
    return features.pooled(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 6))


@query("""with l as (select vec_id, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as dim from embeddings), s as (select dim, avg(x) as m, stddev_pop(x) as d from l group by 1)
select vec_id, dim, round((x - m) / d, 5) as z from l join s using (dim)""")
def scale_standard(spark, sf_dir):
    return features.standard_scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("z", F.round("z", 5))


@query("""select vec_id, array_to_string(list_filter(list_transform(range(1, len(embedding) + 1), lambda i: case when embedding[i] > 0.2 then i - 1 end), lambda i: i is not null), ',') as positions from embeddings""")
def positions_by_class(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(arrays.positions_above(F.col("embedding"), arrays.single(0.2)), ",").alias("positions"))


@query("""with g as (select item_id, unnest(list_transform(range(1, length(text) + 1), lambda i: substr('-' || text || '=', i, 3))) as token from benchmark)
select token, count(*) as n from g where length(token) = 3 group by 1""")
def ngram_vocab(spark, sf_dir):
    return features.vocabulary(table(spark, sf_dir, "benchmark"), text.ngrams(F.col("text"), 3))


@query("""with g as (select unnest(string_split(p_name || ' ' || p_type, ' ')) as token from part), v as (select token, count(*) as n from g group by 1) select token, n from v order by n desc, token limit 5""")
def vocabulary_cut(spark, sf_dir):
    return features.frequent(features.vocabulary(table(spark, sf_dir, "part"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ")), 5)


@query("""with s as (select point, count(*) filter (l_extendedprice <= point) / count(*) as share from lineitem, (values (1000.0::double), (10000.0), (50000.0)) v(point) group by 1) select point, round(share, 6) as share from s""")
def cumulative_share(spark, sf_dir):
    return metrics.cumulative_share(table(spark, sf_dir, "lineitem"), "l_extendedprice", [1000.0, 10000.0, 50000.0]).withColumn("share", F.round("share", 6))


@query("""select user_id, cast(ts as date) as day, round(sum(value), 4) as used from events group by 1, 2""")
def quota_daily(spark, sf_dir):
    return quota.daily_usage(table(spark, sf_dir, "events"), "user_id", "ts", F.col("value")).withColumn("used", F.round("used", 4))


@query("""with recursive e as (select user_id, cast(ts as date) as day, ts, event_id, cast(case when event_type = 'error' then -round_even(value, 0) else round_even(value, 0) end as bigint) as delta,
row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as r from events),
w as (select user_id, day, 0::bigint as r, null::timestamp as ts, null::bigint as event_id, null::bigint as delta, true as accepted, 0::bigint as used from (select distinct user_id, day from e)
union all select e.user_id, e.day, e.r, e.ts, e.event_id, e.delta, e.delta <= 0 or w.used + e.delta <= 500, case when e.delta <= 0 or w.used + e.delta <= 500 then greatest(0, w.used + e.delta) else w.used end from w join e on w.user_id = e.user_id and w.day = e.day and e.r = w.r + 1)
select user_id, day, ts, event_id, delta, accepted, used from w where r > 0""")
def quota_reserve(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "error", -F.rint("value")).otherwise(F.rint("value")).cast("long"))
    return quota.reserved(events, "user_id", "ts", "delta", 500, "event_id")


@query("""select user_id, arg_max(event_type, (ts, event_id)) as event_type, max(ts) as ts from events group by 1""")
def status_latest(spark, sf_dir):
    return quota.latest_status(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query("""with e as (select user_id, floor(epoch(max(ts)))::bigint - floor(epoch(min(ts)))::bigint as seconds from events group by 1)
select user_id, seconds, (seconds // 3600) || 'h ' || (seconds % 3600 // 60) || 'm' as spent from e""")
def elapsed(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = maths.elapsed_seconds(F.col("a"), F.col("b"), F.col("b"))
    return ends.select("user_id", seconds.alias("seconds"), maths.hours_minutes(seconds).alias("spent"))


@query("""select event_type, sum(cast(json_extract_string(props, '$.k') as int))::bigint as k, count(*) as n from events group by 1""")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r <= 5""")
def latest_per_key(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").withColumn("r", rank).where("r <= 5").select("o_custkey", "o_orderkey")


@query("""with g as (select c_mktsegment, c_custkey, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) - 1 as r, count(*) over (partition by c_mktsegment) as n from customer)
select c_mktsegment, c_custkey from g where r in (select floor(p * (n - 1) / 8) from range(9) t(p))""")
def evenly_spaced(spark, sf_dir):
    return features.evenly_spaced(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_acctbal", "c_custkey"], 9).select("c_mktsegment", "c_custkey")


@query("""select o_orderkey, round(o_totalprice * 2, 2) as prediction from orders""")
def scored_distinct(spark, sf_dir):
    double = score.Scorer("double", ("o_totalprice",), lambda: 2.0, lambda model, frame: pd.Series(frame["o_totalprice"] * model))
    return score.scored(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), double).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@query("""with n as (select n, round((1 - 0.9::double) / (1 - pow(0.9, n)), 8) as effective, round(sqrt(1.0 / n), 8) as root from (select count(*) as n from part group by p_brand)) select distinct n, effective, root from n""")
def class_weights(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return counts.select("n", F.round(maths.effective_number_weight(F.col("n")), 8).alias("effective"), F.round(maths.root_inverse_weight(F.col("n")), 8).alias("root")).distinct()
