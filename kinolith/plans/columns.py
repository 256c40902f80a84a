"""Column functions, tokens, features and splits that other queries do not use."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.functions import arrays, maths, text
from kinolith.operators import assembly, curate, features, requests, sampling, validate
from kinolith.plans.base import query, table
from kinolith.streaming import quota


@query("""with s as (select p_partkey, upper(p_name) as seq from part) select p_partkey, translate(seq, 'UZOB', 'XXXX') as known, array_to_string(string_split(seq, ''), ' ') as spaced,
regexp_full_match(upper(seq), '[ACDEFGHIKLMNPQRSTVWYXUZOB]*') as wide from s""")
def residue_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("seq"))
    s = F.col("seq")
    return rows.select(
        "p_partkey", text.rare_residues_to_x(s).alias("known"), text.spaced(s).alias("spaced"), text.in_alphabet(s, "ACDEFGHIKLMNPQRSTVWYXUZOB", True).alias("wide")
    )


@query("""with t as (select page_id, case page_id % 5 when 0 then null when 1 then ' ' when 2 then ' NaN' when 3 then '-' else url end as v from pages)
select page_id, v is null or lower(trim(v)) in ('', 'nan', 'none', '-') as missing, trim(split_part(page_id || '.0.0.1 , 10.0.0.2', ',', 1)) as address from t""")
def missing_and_addresses(spark, sf_dir):
    i = F.col("page_id")
    v = F.when(i % 5 == 0, F.lit(None)).when(i % 5 == 1, " ").when(i % 5 == 2, " NaN").when(i % 5 == 3, "-").otherwise(F.col("url"))
    header = F.concat(i.cast("string"), F.lit(".0.0.1 , 10.0.0.2"))
    return table(spark, sf_dir, "pages").select("page_id", text.nullish(v).alias("missing"), text.first_address(header).alias("address"))


_ATOMS_SQL = ", ".join(f"'{a}'" for a in text.ATOMS)


@query(f"""with t as (select c_custkey, 'C' || [{_ATOMS_SQL}][1 + c_custkey % {len(text.ATOMS)}] || case c_custkey % 5 when 0 then 'Cln' when 1 then '%12N' when 2 then 'Br+2' when 3 then '[nH]' else 'Sn1-3' end || lower(c_name) as smiles from customer)
select c_custkey, array_to_string(regexp_extract_all(smiles, '%.{{0,2}}|{'|'.join(text.ATOMS)}|[+-][234]|.'), ' ') as tokens from t""")
def line_notation_tokens(spark, sf_dir):
    i = F.col("c_custkey")
    atom = F.element_at(F.array(*map(F.lit, text.ATOMS)), (i % len(text.ATOMS)).cast("int") + 1)
    middle = F.when(i % 5 == 0, "Cln").when(i % 5 == 1, "%12N").when(i % 5 == 2, "Br+2").when(i % 5 == 3, "[nH]").otherwise("Sn1-3")
    tokens = text.smiles_tokens(F.concat(F.lit("C"), atom, middle, F.lower("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tokens, " ").alias("tokens"))


@query("""with k as (select p_partkey, string_split(p_name, ' ') as t from part), i as (select p_partkey, list_transform(t, lambda w: case w when 'small' then 5 when 'red' then 6 when 'ring' then 7 else 1 end) as ids from k)
select p_partkey, array_to_string(list_concat([3], ids, [2], list_transform(range(0, 6 - len(ids)), lambda x: 0)), ',') as ids from i""")
def token_ids_padded(spark, sf_dir):
    ids = F.create_map(*[F.lit(x) for pair in (("small", 5), ("red", 6), ("ring", 7)) for x in pair])
    padded = text.padded_ids(F.split("p_name", " "), ids, 8)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(padded, ",").alias("ids"))


@query("""with v(token, id) as (values ('small', 1), ('widget', 2)), t as (select p_partkey, unnest(string_split(p_name, ' ')) as token, generate_subscripts(string_split(p_name, ' '), 1) - 1 as place from part)
select p_partkey, place::int as place, coalesce(id, 0)::int as id from t left join v using (token)""")
def token_ids(spark, sf_dir):
    ids = spark.createDataFrame([("small", 1), ("widget", 2)], "token string, id int")
    return features.token_ids(table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " "), ids)


@query("""with t as (select p_partkey, unnest(string_split(p_name, ' ')) as token, generate_subscripts(string_split(p_name, ' '), 1) as place from part), f as (select token, min((p_partkey, place)) as seen from t group by 1)
select token, row_number() over (order by seen, token) - 1 as id from f""")
def growing_dictionary(spark, sf_dir):
    return features.growing_dictionary(table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " ")).select("token", "id")


@query("""with e as (select vec_id, list_transform(embedding, lambda x: exp(x::double / 15)) as p, embedding as v from embeddings)
select vec_id, array_to_string(list_transform(p, lambda x: round(x / list_sum(p) * 1e6)::int), ',') as shares, array_to_string(list_transform(v, lambda x: round(round(x::double / list_max(v)::double, 4) * 1e4)::int), ',') as profile from e""")
def logits_and_profiles(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    whole = lambda a, by: F.array_join(F.transform(a, lambda x: F.round(x * by).cast("int")), ",")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", whole(arrays.softmax(v), 1e6).alias("shares"), whole(arrays.scaled_by_maximum(v), 1e4).alias("profile")
    )


@query("""select vec_id, array_to_string(list_transform(range(0, 12), lambda i: case when i in (vec_id % 12, (vec_id + 5) % 12) then 1 else 0 end), '') as sites, array_to_string(list_transform(range(0, 6), lambda i: case when i = vec_id % 6 then label else 0 end), ',') as dense from embeddings""")
def sparse_to_dense(spark, sf_dir):
    i = F.col("vec_id")
    sites = text.multi_hot(F.concat_ws(", ", (i % 12).cast("string"), ((i + 5) % 12).cast("string")), F.lit(12))
    dense = arrays.dense(F.array((i % 6).cast("int")), F.array(F.col("label").cast("double")), 6)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(sites, "").alias("sites"), F.array_join(F.transform(dense, lambda x: x.cast("int")), ",").alias("dense"))


@query("""with w as (select p_partkey, list_distinct(string_split(p_name, ' ')) as a, list_distinct(string_split(lower(p_type) || ' small ring', ' ')) as b from part)
select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) as similarity from w""")
def fingerprint_similarity(spark, sf_dir):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array_distinct(F.split(F.concat(F.lower("p_type"), F.lit(" small ring")), " "))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(arrays.tanimoto(a, b), 9).alias("similarity"))


@query("""with v as (select vec_id, embedding[1:31] as a, embedding[32:62] as b, abs(embedding[63]::double) + 0.1 as u, abs(embedding[64]::double) + 0.1 as w from embeddings)
select vec_id, array_to_string(list_transform(range(1, 32), lambda i: round((a[i]::double * u + b[i]::double * w) / (u + w) * 1e5)::int), ',') as pooled from v""")
def weighted_pooling(spark, sf_dir):
    """Two halves of a vector, weighted by its last two components."""
    v = F.col("embedding")
    weights = F.array(*[F.abs(F.get(v, F.lit(i)).cast("double")) + 0.1 for i in (62, 63)])
    mean = arrays.weighted_mean(F.array(F.slice(v, 1, 31), F.slice(v, 32, 31)), weights)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(mean, lambda x: F.round(x * 1e5).cast("int")), ",").alias("pooled"))


@query("""with l as (select vec_id, unnest(embedding)::double as x, (generate_subscripts(embedding, 1) - 1)::int as dim from embeddings), s as (select dim, quantile_cont(x, 0.5) as m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as w from l group by 1)
select vec_id, dim, round((x - m) / w, 5) as z from l join s using (dim)""")
def scale_robust(spark, sf_dir):
    return features.robust_scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("z", F.round("z", 5))


@query("""with p as (select label, unnest(list_filter(range(0, 64), lambda i: embedding[i + 1] > 0.2))::int as position from embeddings) select label, position, count(*) as n from p group by 1, 2""")
def position_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.explode(arrays.positions_above(F.col("embedding"), arrays.single(0.2))).alias("position"))
    return rows.groupBy("label", "position").agg(F.count("*").alias("n"))


@query("""select event_id, 86400 - (epoch(date_trunc('second', ts))::bigint % 86400) as left_today, strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, least(100, round(event_id % 7 * 100.0 / 5))::int as percent from events""")
def clock_forms(spark, sf_dir):
    done = (F.col("event_id") % 7).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", maths.seconds_to_midnight(F.col("ts")).alias("left_today"), maths.day_key(F.col("ts")).alias("day"), maths.iso_zulu(F.col("ts")).alias("at"), maths.percent_done(done, F.lit(5)).alias("percent")
    )


@query("""select event_id, event_id % 10 as done, (event_id % 4)::int as total, case when event_id % 4 > 0 then least(100, round(event_id % 10 * 100.0 / (event_id % 4)))::int else 0 end as percent from events where event_type <> 'error'""")
def progress_lines(spark, sf_dir):
    said = F.when(F.col("event_type") != "error", F.concat(F.lit("done "), (F.col("event_id") % 10).cast("string"), F.lit("/"), (F.col("event_id") % 4).cast("string"), F.lit(" rows"))).otherwise("nothing")
    lines = table(spark, sf_dir, "events").select("event_id", said.alias("line"))
    return quota.progress(lines, "line").select("event_id", F.col("done").cast("long").alias("done"), "total", "percent")


@query("""select user_id, count(*) as jobs, count(*) filter (cast(ts as date) = (select cast(max(ts) as date) from events)) as today from events group by 1""")
def user_rollup(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    today = events.agg(F.to_date(F.max("ts")).alias("d")).first()["d"]  # one value
    return events.groupBy("user_id").agg(F.count("*").alias("jobs"), F.count_if(F.to_date("ts") == F.lit(today)).alias("today"))


@query("""with r as (select c_custkey, row_number() over (order by c_custkey) - 1 as r, count(*) over () as n from customer) select c_custkey from r where least(4, r // greatest(1, n // 5)) = 2""")
def contiguous_fold(spark, sf_dir):
    rows = assembly.dense_rank_over_ranges(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], "r")
    return sampling.contiguous_fold(rows, "r", 5, 2).select("c_custkey")


@query("""select c_custkey, r::int as repeat from customer, range(10) t(r) where (((c_custkey * 31 + r) * 7919 + 42 * 104729) % 999983) / 999983 < 0.9""")
def repeated_samples(spark, sf_dir):
    return sampling.repeated_samples(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 0.9, 10)


@query("""with b as (select o_orderkey, floor(log10(o_totalprice) * 10)::int as bin from orders), c as (select bin, count(*) as n from b group by 1), s as (select min(bin) as a, max(bin) as z from c), f as (select g.bin::int as bin, coalesce(n, 0) as n from (select unnest(range(a, z + 1)) as bin from s) g left join c on g.bin = c.bin),
w as (select bin, 0.5 * lag(n, 1, 0) over (order by bin) + n + 0.5 * lead(n, 1, 0) over (order by bin) as d from f) select o_orderkey, bin, round(1.0::double / d::double, 9) as weight from b join w using (bin)""")
def density_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", maths.unit_bin(F.log10("o_totalprice"), 10).alias("bin"))
    return sampling.density_weights(rows, "bin").select("o_orderkey", "bin", F.round("weight", 9).alias("weight"))


@query("""with e as (select floor(min(o_totalprice)) as low from orders) select o_orderkey, (floor((o_totalprice - low) / 25000) + 1)::int as bin from orders, e""")
def width_bins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    low = orders.agg(F.min("o_totalprice").alias("low"))
    return orders.crossJoin(F.broadcast(low)).select("o_orderkey", maths.width_bin(F.col("o_totalprice"), F.col("low"), 25_000.0).alias("bin"))  # one row


@query("""select o_orderkey, round(exp(-pow(o_totalprice - 150000, 2) / (2 * pow(40000, 2))), 9) as affinity from orders""")
def affinities(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(maths.affinity(F.col("o_totalprice") - 150_000, F.lit(80_000.0)), 9).alias("affinity"))


@query("""select l_orderkey, l_linenumber from lineitem where l_extendedprice <= 50000 and l_quantity <> -999 and not contains(lower(l_returnflag), 'r')""")
def usable_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", F.when(F.col("l_returnflag") == "R", "Mutant").otherwise("wildtype"))
    return curate.usable(rows, "l_extendedprice", "kind", 50_000).select("l_orderkey", "l_linenumber")


@query("""with s as (select s_suppkey as id, s_nationkey as seq from supplier), p as (select c_nationkey, min(c_mktsegment) as one from customer where c_acctbal > 9500 group by 1 having min(c_mktsegment) = max(c_mktsegment)),
f as (select l_orderkey, l_linenumber, l_suppkey as a, case when l_linenumber % 2 = 0 then (l_suppkey + 25) % (select count(*) from supplier) end as b, (l_partkey % 25)::int as nation from lineitem)
select l_orderkey, l_linenumber, coalesce(case when f.b is null or x.seq = y.seq then cast(x.seq as varchar) end, p.one) as sequence from f left join s x on x.id = f.a left join s y on y.id = f.b left join p on p.c_nationkey = f.nation""")
def attach_sequence(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    n = suppliers.count()
    lines = table(spark, sf_dir, "lineitem")
    second = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), ((F.col("l_suppkey") + 25) % n).cast("string"))).otherwise("")
    facts = lines.select("l_orderkey", "l_linenumber", F.concat(F.col("l_suppkey").cast("string"), second).alias("ids"), (F.col("l_partkey") % 25).cast("int").alias("nation"))
    by_id = suppliers.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_nationkey").cast("string").alias("sequence"))
    by_pair = table(spark, sf_dir, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("sequence"))
    return assembly.attach_sequence(facts, by_id, by_pair, "ids", ["nation"]).select("l_orderkey", "l_linenumber", "sequence")


@query("""with p as (select item_id, unnest(string_split(text, ' ')) as part, generate_subscripts(string_split(text, ' '), 1) - 1 as place from benchmark), k as (select distinct unnest(string_split(text, ' ')) as part from conversations)
select item_id as "row", place::int as place, part from p where part <> '' and part not in (select part from k where part is not null)""")
def invalid_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit(";")).alias("list"))
    known = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("part"))
    return validate.invalid_parts(rows, "list", "item_id", known, "part")


@query("""select case event_type when 'click' then 'C' when 'error' then 'E' end as code, count(*) as n from events group by 1""")
def recoded(spark, sf_dir):
    code = assembly.recoded(F.col("event_type"), {"click": "C", "error": "E"})
    return table(spark, sf_dir, "events").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query("""with b as (select l_partkey, max(l_extendedprice) as price, list_distinct(list(l_returnflag)) as f from lineitem group by 1) select l_partkey, price, array_to_string(list_sort(f), ';') as flags from b""")
def maxima_with_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flags"))
    return curate.maxima_with_paths(rows, ["l_partkey"], "price", "flags")


@query("""select 'first' as method, count(*) as n, '{"method":"first","n":"' || count(*) || '","best":["' || max(o_orderkey) || '","NaN"]}' as result from orders""")
def nested_result(spark, sf_dir):
    one = table(spark, sf_dir, "orders").agg(F.lit("first").alias("method"), F.count("*").alias("n"), F.array(F.max("o_orderkey"), F.lit(None).cast("long")).alias("best"))
    return requests.status_rows(one, ["method", "n", "best"]).select("method", "n", F.col("status").alias("result"))


@query("""with a as (select p_partkey, p_name from part where p_partkey % 3 = 0), b as (select p_partkey, p_name from part where p_partkey % 3 <> 2) select p_name, min(p) as p_partkey, arg_min(f, (f, p)) as file from (select p_name, p_partkey as p, 0 as f from a union all select p_name, p_partkey, 1 from b) where f = 0 or p_name not in (select p_name from a) group by 1""")
def first_file_wins(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_name", "p_partkey")
    files = parts.where("p_partkey % 3 = 0").withColumn("file", F.lit(0)).unionByName(parts.where("p_partkey % 3 != 2").withColumn("file", F.lit(1)))
    return assembly.first_per_key(files, ["p_name"], ["file", "p_partkey"]).select("p_name", "p_partkey", "file")


@query("""with n as (select o_orderkey as i, o_orderstatus as s from orders) select n.i, case when m.s is null then n.s else left(sha256(n.s || '|' || m.s || ':1'), 16) end as label from n left join n m on m.i = n.i + 3""")
def graph_labels(spark, sf_dir):
    """Chains of every third order; one round of relabelling by the next node of the chain."""
    nodes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("mol"), F.col("o_orderkey").alias("i"), F.col("o_orderstatus").alias("label"))
    edges = nodes.select("mol", "i", (F.col("i") + 3).alias("j"), F.lit(1).alias("bond"))
    return features.graph_labels(nodes, edges, 1).select("i", "label")
