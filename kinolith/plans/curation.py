"""Curation, validation, registry and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinolith.functions import arrays, maths, text
from kinolith.operators import assembly, curate, registry, validate
from kinolith.plans.base import placed_table, query, table


@query("""select l_partkey, l_suppkey, max(l_extendedprice) as l_extendedprice, arg_min(l_linestatus, (-l_extendedprice, l_linestatus)) as l_linestatus
from lineitem group by all having arg_min(l_linestatus, (-l_extendedprice, l_linestatus)) = 'O'""")
def dedupe_max_unit(spark, sf_dir):
    best = curate.max_with_unit(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_extendedprice", "l_linestatus")
    return best.where("l_linestatus = 'O'")


@query("""select array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') as p_name, p_type, max(p_retailprice) as p_retailprice, count(*) as n
from part group by 1, 2""")
def dedupe_set_key(spark, sf_dir):
    return curate.max_per_set_key(table(spark, sf_dir, "part"), "p_name", "p_retailprice", " ", ["p_type"]).select("p_name", "p_type", "p_retailprice", "n")


@query("""select o_custkey, string_agg(cast(o_orderkey as varchar), ';' order by o_orderkey) as orders from orders group by 1""")
def list_per_key(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("orders"))
    return assembly.regrouped(orders, "o_custkey", "o_orderkey", "orders")


@query("""select l_orderkey, a.l_extendedprice as value_one, b.l_extendedprice as value_two from lineitem a join lineitem b using (l_orderkey)
where a.l_returnflag = 'A' and b.l_returnflag = 'R'""")
def self_join_entry(spark, sf_dir):
    return curate.same_entry(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "A", "R", "l_extendedprice")


@query("""with words(word, pos) as (values ('old', 0), ('all', 1), ('widget', 2), ('red', 3)),
hits as (select p_name, arg_min(word, pos) as word from (select distinct p_name from part) p join words on contains(lower(p_name), word) group by 1)
select p_partkey, p_name, coalesce(word, '*') as word from part left join hits using (p_name)""")
def containment_join(spark, sf_dir):
    words = spark.createDataFrame([("old", 0), ("all", 1), ("widget", 2), ("red", 3)], "word string, pos int")
    found = assembly.contained_in(table(spark, sf_dir, "part"), words, "p_name", "word", "pos")
    return found.select("p_partkey", "p_name", "word")


@query("""with single as (select c_nationkey, c_mktsegment, min(c_custkey) as c_custkey from customer group by 1, 2 having count(distinct c_custkey) = 1)
select s_suppkey, s_nationkey, c_custkey from supplier left join single on s_nationkey = c_nationkey and c_mktsegment = 'MACHINERY'""")
def conditional_attach(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), F.lit("MACHINERY").alias("c_mktsegment"))
    customers = table(spark, sf_dir, "customer")
    found = assembly.attach_if_single(suppliers, customers, ["c_nationkey", "c_mktsegment"], "c_custkey")
    return found.select("s_suppkey", F.col("c_nationkey").alias("s_nationkey"), "c_custkey")


@query("""with facts as (select l_partkey, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) as fact from lineitem where l_returnflag = 'R' group by 1)
select p_partkey, coalesce(fact, p_retailprice) as price, case when fact is not null then 'experiment' when p_retailprice is not null then 'prediction' end as source
from part left join facts on p_partkey = l_partkey""")
def lookup_first_match(spark, sf_dir):
    facts = placed_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("p_partkey"), F.struct("l_orderkey", "l_linenumber", "place").alias("position"), F.col("l_extendedprice").alias("price")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"))
    return assembly.override(parts, facts, ["p_partkey"], "price").select("p_partkey", "price", "source")


@query("""with facts as (select l_partkey, p_name, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) as fact from lineitem join part on (l_partkey + 1) // 2 * 2 = p_partkey where l_returnflag = 'R' group by 1, 2)
select p_partkey, coalesce(fact, p_retailprice) as price, case when fact is not null then 'experiment' else 'prediction' end as source from part left join facts on p_partkey = l_partkey and part.p_name = facts.p_name""")
def lookup_guarded(spark, sf_dir):
    """Facts of odd parts carry the name of the next part: they count only where that name is the same."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("named"), "p_name")
    facts = placed_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumn("named", F.floor((F.col("l_partkey") + 1) / 2).cast("long") * 2).join(names, "named").select(
        F.col("l_partkey").alias("p_partkey"), "p_name", F.struct("l_orderkey", "l_linenumber", "place").alias("position"), F.col("l_extendedprice").alias("price")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    return assembly.override(parts, facts, ["p_partkey"], "price", guard="p_name").select("p_partkey", "price", "source")


@query("""select p_partkey, param, value from (
select l_partkey as p_partkey, 'first' as param, arg_min(l_extendedprice, (l_orderkey, l_linenumber)) as value from lineitem where l_returnflag = 'R' group by 1
union all select l_partkey, 'second', arg_min(l_quantity, (l_orderkey, l_linenumber)) from lineitem where l_returnflag = 'A' group by 1)""")
def both_lookup(spark, sf_dir):
    lines = placed_table(spark, sf_dir, "lineitem")
    found = []
    for flag, name, value in (("R", "first", "l_extendedprice"), ("A", "second", "l_quantity")):
        rows = lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_linenumber", "place", F.col(value).alias("value"))
        first = assembly.first_per_key(rows, ["p_partkey"], ["l_orderkey", "l_linenumber", "place"])
        found.append(first.select("p_partkey", F.lit(name).alias("param"), "value"))
    return found[0].unionByName(found[1])


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def anti_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return assembly.misses(docs, table(spark, sf_dir, "labels"), ["doc_id"])


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey || '/' || l_quantity::int as kind, l_orderkey % 10 < 3 as train from lineitem)
select l_orderkey, l_linenumber, l_partkey, kind from r where not train and (l_partkey not in (select l_partkey from r where train) or kind not in (select kind from r where train))""")
def unseen_pairs(spark, sf_dir):
    kind = F.concat_ws("/", "l_suppkey", F.col("l_quantity").cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kind.alias("kind"))
    return assembly.unseen(rows.where("l_orderkey % 10 >= 3"), rows.where("l_orderkey % 10 < 3"), ["l_partkey", "kind"])


@query("""select 'both' as part, count(*) as n from (select text from documents intersect select text from benchmark)
union all select 'only_documents', count(*) from (select text from documents except select text from benchmark)
union all select 'all', count(*) from (select text from documents union select text from benchmark)""")
def set_ops(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("text") for t in ("documents", "benchmark"))
    parts = {"both": a.intersect(b), "only_documents": a.subtract(b), "all": a.union(b).distinct()}
    counted = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""with j as (select doc_id, cast(quality as varchar) as quality, cast(toxic as varchar) as toxic, lang from documents left join labels using (doc_id)),
c as (select 'quality' as "column", doc_id, quality is null or trim(quality) = '' as blank from j union all select 'toxic', doc_id, toxic is null or trim(toxic) = '' from j union all select 'lang', doc_id, lang is null or trim(lang) = '' from j)
select "column", count(*) as n, count(*) filter (blank) as blanks, case when count(*) filter (blank) > 0.9 * count(*) then 'empty' when count(*) filter (blank) > 0.1 * count(*) then 'gaps' else 'ok' end as verdict,
case when count(*) filter (blank) <= 10 then coalesce(string_agg(cast(doc_id as varchar), ',' order by doc_id) filter (blank), '') else '' end as row_list from c group by 1""")
def column_emptiness(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return validate.column_emptiness(joined, ["quality", "toxic", "lang"], "doc_id")


@query("""select item_id as "row", 'invalid characters' as reason, array_to_string(list_sort(list_distinct(string_split(regexp_replace(upper(replace(text, 'ß', 's')), '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), ''))), '') as characters
from benchmark where not regexp_full_match(upper(replace(text, 'ß', 's')), '[ACDEFGHIKLMNPQRSTVWY]*') and trim(text) <> ''
union all select item_id, 'empty', '' from benchmark where text is null or trim(text) = ''""")
def alphabet_check(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("text", F.upper(F.replace("text", F.lit("ß"), F.lit("s"))))
    return validate.invalid_sequences(rows, "text", "item_id")


@query("""with v as (select item_id, case when text is null or trim(text) = '' then 'empty' when not regexp_full_match(text, '[ACDEFGHIKLMNPQRSTVWY]*') then 'invalid characters' end as reason from benchmark)
select reason, count(*) over (partition by reason) as n, row_number() over (partition by reason order by item_id) - 1 as place, item_id as "row" from v where reason is not null""")
def invalid_by_reason(spark, sf_dir):
    return validate.by_reason(validate.invalid_sequences(table(spark, sf_dir, "benchmark"), "text", "item_id"))


@query("""select m as "method", l as "limit", (select count(*) from documents where length(text) > l) as n
from (values ('A', 1024), ('B', 1024), ('C', 1000), ('E', 1500), ('F', 1500)) v(m, l)""")
def length_violations(spark, sf_dir):
    return validate.length_violations(table(spark, sf_dir, "documents"), "text").select("method", "limit", F.col("n").cast("long").alias("n"))


@query("""select doc_id, case when length(text) > 1000 then left(text, 500) || right(text, 500) else text end as cut, left(text, 1022) as head,
length(text) <= 1000 as kept from documents""")
def truncate_head_tail(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.head_tail(F.col("text"), 1000).alias("cut"), text.prefix(F.col("text"), 1022).alias("head"), (F.length("text") <= 1000).alias("kept")
    )


@query("""select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w)), ';') as tokens from part""")
def token_explode_regroup(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(arrays.split_list(F.col("p_name"), " ")).alias("place", "tokens"))
    return assembly.regrouped(parts.withColumn("tokens", F.upper("tokens")), "p_partkey", "place", "tokens")


@query("""with t as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then 'variant ' when l_linenumber % 3 = 1 then 'mutant ' else 'Mutated form ' end || l_returnflag || l_partkey || l_linestatus || case when l_linenumber % 2 = 0 then ' and ' || l_linestatus || l_suppkey || l_returnflag else '' end as comment from lineitem)
select l_orderkey, l_linenumber, array_to_string(regexp_extract_all(comment, '[A-Z][0-9]+[A-Z]'), '/') as codes from t where (contains(lower(comment), 'mutant') or contains(lower(comment), 'mutated')) and regexp_matches(comment, '[A-Z][0-9]+[A-Z]')""")
def mutation_regex(spark, sf_dir):
    lead = F.when(F.col("l_linenumber") % 3 == 0, "variant ").when(F.col("l_linenumber") % 3 == 1, "mutant ").otherwise("Mutated form ")
    more = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" and "), "l_linestatus", "l_suppkey", "l_returnflag")).otherwise("")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(lead, "l_returnflag", "l_partkey", "l_linestatus", more).alias("comment"))
    return curate.with_codes(lines, "comment").select("l_orderkey", "l_linenumber", "codes")


@query("""with s as (select item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as seq from benchmark)
select item_id, left(seq, 1) || '1W/' || substr(seq, 3, 1) || '3W' as codes, 'W' || substr(seq, 2, 1) || 'W' || substr(seq, 4) as mutant,
cast((left(seq, 1) <> 'W') as int) + cast((substr(seq, 3, 1) <> 'W') as int) as found from s where length(seq) >= 3""")
def apply_infer_mutation(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq")).where(F.length("seq") >= 3)
    codes = F.array(F.concat(F.substring("seq", 1, 1), F.lit("1W")), F.concat(F.substring("seq", 3, 1), F.lit("3W")))
    done = rows.withColumn("codes", codes).withColumn("mutant", text.apply_mutations(F.col("seq"), F.col("codes")))
    inferred = text.inferred_mutations(F.col("seq"), F.col("mutant"))
    return done.select("item_id", F.array_join("codes", "/").alias("codes"), "mutant", F.size(inferred).alias("found"))


@query("""with u as (select text as seq, count(*) as uses_count, min(doc_id) as first_position from documents where trim(text) <> '' group by 1),
b as (select *, sha256(seq) as sha256, row_number() over (partition by left(sha256(seq), 12) order by first_position, sha256(seq)) - 1 as r from u)
select case when r > 0 then left(sha256, 12) || '_' || r else left(sha256, 12) end as id, sha256, cast(length(seq) as int) as len, uses_count, first_position from b""")
def registry_ids(spark, sf_dir):
    return registry.register(table(spark, sf_dir, "documents"), "text", "doc_id").drop("seq")


@query("""with u as (select text as seq, count(*) - 1 as uses_count, sha256(text) as sha256, min(doc_id) as first_position from documents where trim(text) <> '' group by 1),
r as (select *, left(sha256, 12) || case when row_number() over (partition by left(sha256, 12) order by first_position, sha256) > 1 then '_' || (row_number() over (partition by left(sha256, 12) order by first_position, sha256) - 1) else '' end as id from u),
b as (select *, case when first_position % 7 = 0 then 'x' || substr(id, 2) else id end as changed from r)
select count(*) as n, cast(sum(uses_count) as bigint) as uses, count(*) filter (uses_count = 0) as unused, round(count(*) filter (uses_count = 0) / count(*), 9) as unused_share,
(select count(*) from (select left(sha256, 1) from u group by 1 having count(*) > 1)) as prefixes, (select cast(coalesce(sum(k - 1), 0) as bigint) from (select count(*) as k from u group by left(sha256, 1) having count(*) > 1)) as extra_ids,
count(*) filter (split_part(changed, '_', 1) <> left(sha256, 12)) as mismatches from b""")
def registry_stats(spark, sf_dir):
    """Uses after the first one, prefixes of one digit, and ids of which every seventh document's first was spoilt."""
    reg = registry.register(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("uses_count", F.col("uses_count") - 1)
    spoilt = reg.withColumn("id", F.when(F.col("first_position") % 7 == 0, F.concat(F.lit("x"), F.substring("id", 2, 100))).otherwise(F.col("id")))
    # three one-row results side by side
    found = registry.totals(reg).join(registry.prefix_collisions(reg, 1)).join(registry.mismatches(spoilt))
    return found.withColumn("unused_share", F.round("unused_share", 9))


@query("""select 'shortest' as which, (select arg_min(doc_id, (n_chars, doc_id)) from documents) as doc_id, (select min(n_chars) from documents) as n_chars
union all select 'longest', (select arg_min(doc_id, (-n_chars, doc_id)) from documents), (select max(n_chars) from documents)""")
def registry_extremes(spark, sf_dir):
    return registry.extremes(table(spark, sf_dir, "documents"), "n_chars", "doc_id")


@query("""select lang, median(n_chars) as median, count(*) as n from documents group by 1""")
def median_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("n_chars").cast("double").alias("n_chars"))
    return assembly.quantiles(docs, ["lang"], "n_chars", {"median": 0.5}).join(docs.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n")), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "median", "n")


@query("""with o as (select n_chars as v, row_number() over (order by n_chars) as r, count(*) over () as n from documents)
select q, (select min(v) from o where r >= ceil(q * n)) as value from (values (0.05::double), (0.25), (0.5), (0.75), (0.95)) t(q)""")
def length_quantiles(spark, sf_dir):
    return registry.length_quantiles(table(spark, sf_dir, "documents"), "n_chars", [0.05, 0.25, 0.5, 0.75, 0.95])


@query("""select user_id, count(*) as uses, max(ts) as last_seen from events group by 1 order by uses desc, last_seen desc, user_id limit 10""")
def registry_top(spark, sf_dir):
    uses = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("uses"), F.max("ts").alias("last_seen"))
    return uses.orderBy(F.desc("uses"), F.desc("last_seen"), "user_id").limit(10)


@query("""select d as days, count(*) as n from events, (select max(ts) as now from events), (values (1), (7), (30)) v(d) where ts >= now - d * interval 1 day group by 1""")
def recent_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now")).first()["now"]  # one value
    return registry.recent_counts(events, "ts", F.lit(now).cast("timestamp_ntz"), [1, 7, 30])


@query("""select l_returnflag, l_linestatus, count(*) as n, count(distinct l_partkey) as parts, count(distinct lower(l_returnflag || l_linestatus)) as kinds, count(distinct l_suppkey) as suppliers from lineitem group by all
having count(distinct l_suppkey) >= 2""")
def distinct_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        F.countDistinct("l_partkey").alias("parts"),
        F.countDistinct(F.lower(F.concat("l_returnflag", "l_linestatus"))).alias("kinds"),
        F.countDistinct("l_suppkey").alias("suppliers"),
    )
    return counts.where("suppliers >= 2")


@query("""with b as (select l_partkey, max(l_extendedprice) as reference from lineitem where l_returnflag = 'N' group by 1)
select l_orderkey, l_linenumber, case when l_extendedprice / reference < 0.5 then 'decreased' when l_extendedprice / reference < 2 then 'like' else 'increased' end as class
from lineitem join b using (l_partkey) where l_returnflag <> 'N'""")
def ratio_class(spark, sf_dir):
    rows = curate.against_reference(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", "N", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", maths.ratio_class(F.col("ratio")).alias("class"))


@query("""select s_suppkey, concat_ws('. ', 'Supplier ' || s_name, case when s_acctbal < 0 then 'In debt' end, 'Nation ' || n_name, case when s_acctbal >= 5000 then 'Strong' when s_acctbal >= 0 then 'Fair' else 'Unknown' end) as info
from supplier join nation on s_nationkey = n_nationkey""")
def extra_info_text(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    strong, fair = (F.col("s_acctbal") >= 5000).cast("int"), (F.col("s_acctbal") >= 0).cast("int")
    return joined.select(
        "s_suppkey",
        text.sentence(
            F.concat(F.lit("Supplier "), "s_name"),
            F.when(F.col("s_acctbal") < 0, "In debt"),
            F.concat(F.lit("Nation "), "n_name"),
            text.provenance(strong, fair, F.lit(0), ["Strong", "Fair", "Other"]),
        ).alias("info"),
    )


@query(r"""with t as (select page_id, case page_id % 6 when 0 then 'run /opt/conda/bin/conda in /home/u' || page_id || '/x' when 1 then 'made /tmp/tmp' || page_id || '_a/queryDB_h and result.m8 pref_' || page_id when 2 then 'read /srv/db/targets_a and targets_a, targets_ab'
when 3 then 'see ' || url when 4 then '/data/media/sequence_info/' || page_id || ' in /data' else 'kept queryDB /tmp/x' || page_id || '.fasta' end as line from pages),
a as (select page_id, regexp_replace(replace(line, '/srv/db/targets_a', 'TARGET_DB(A)'), '\btargets_a\b', 'TARGET_DB(A)', 'g') as line from t),
b as (select page_id, replace(replace(line, '/data/media', '[MEDIA]'), '/data', '[DATA]') as line from a),
c as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '/tmp/tmp[a-zA-Z0-9_]+/queryDB(?:_h)?', '[TMP_QUERY_DB]', 'g'), '/tmp/tmp[a-zA-Z0-9_]+/resultDB(?:_h)?', '[TMP_RESULT_DB]', 'g'), '/tmp/tmp[a-zA-Z0-9_]+/result\.m8', '[TMP_RESULT_M8]', 'g'), '/tmp/tmp[a-zA-Z0-9_]+', '[TMP_DIR]', 'g'), '/tmp/[^\s]+', '[TMP]', 'g') as line from b),
d as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\bqueryDB_h\b', '[QUERY_DB_H]', 'g'), '\bresultDB_h\b', '[RESULT_DB_H]', 'g'), '\bqueryDB\b', '[QUERY_DB]', 'g'), '\bresultDB\b', '[RESULT_DB]', 'g'), '\bresult\.m8\b', '[RESULT_M8]', 'g'), '\bpref_\d+\b', '[PREF_DB]', 'g') as line from c),
e as (select page_id, regexp_replace(regexp_replace(line, '(?:/home/[^/\s]+/anaconda3/bin/conda|/opt/conda/bin/conda)', '[CONDA]', 'g'), '/home/[^/\s]+', '[HOME]', 'g') as line from d)
select page_id, regexp_replace(line, '(^|[^\w.-])/[^\s]+', '\1[PATH]', 'g') as line from e""")
def log_redaction(spark, sf_dir):
    i, url = F.col("page_id").cast("string"), F.col("url")
    line = F.element_at(
        F.array(
            F.concat(F.lit("run /opt/conda/bin/conda in /home/u"), i, F.lit("/x")),
            F.concat(F.lit("made /tmp/tmp"), i, F.lit("_a/queryDB_h and result.m8 pref_"), i),
            F.lit("read /srv/db/targets_a and targets_a, targets_ab"),
            F.concat(F.lit("see "), url),
            F.concat(F.lit("/data/media/sequence_info/"), i, F.lit(" in /data")),
            F.concat(F.lit("kept queryDB /tmp/x"), i, F.lit(".fasta")),
        ),
        (F.col("page_id") % 6).cast("int") + 1,
    )
    redacted = text.redacted_line(line, {"A": "/srv/db/targets_a"}, {"/data/media": "[MEDIA]", "/data": "[DATA]"})
    return table(spark, sf_dir, "pages").select("page_id", redacted.alias("line"))


@query("""select c_custkey, first.o_orderkey as first_order, last.o_orderkey as last_order from customer
join (select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1) first on c_custkey = first.o_custkey
join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by 1) last on c_custkey = last.o_custkey""")
def first_last_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey")
    ends = assembly.first_per_key(orders, ["o_custkey"], ["at"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))
    last = assembly.last_per_key(orders, ["o_custkey"], "at").select("o_custkey", F.col("o_orderkey").alias("last_order"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(ends.join(last, "o_custkey"), F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


@query("""with w as (select p_name, min(p_partkey) as seen from part group by 1)
select p_name, row_number() over (order by seen) - 1 as id from w""")
def first_seen_ids(spark, sf_dir):
    return assembly.first_seen_ids(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query("""select n.o_orderkey as id, n.o_orderpriority as seq, case when n.o_orderkey % 2 = 0 then 'same' when n.o_orderkey % 5 = 1 then 'id_conflict' else 'seq_conflict' end as class from orders n where n.o_orderkey % 2 = 0 or n.o_orderkey % 5 = 1
union all select o_orderkey, o_orderpriority, 'seq_conflict' from orders where not (o_orderkey % 2 = 0 or o_orderkey % 5 = 1)""")
def conflict_classes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("seq"))
    changed = F.when((F.col("id") % 2 != 0) & (F.col("id") % 5 == 1), F.concat(F.lit("x"), "seq")).otherwise(F.col("seq"))
    old = orders.where("id % 2 = 0 or id % 5 = 1").select("id", changed.alias("seq"))
    return assembly.conflicts(orders, old)
