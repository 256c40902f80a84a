"""Ordering, first and last rows, dense ids, projections and joins back to rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.operators.staging import join_facts, settled


def first_per_key(rows: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The row of each key that comes first by position.

    A minimum over structs, so that each partition reduces a hot key before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.struct(*position, *[c for c in rest if c not in position])
    best = rows.groupBy(*keys).agg(F.min(ordered).alias("best"))
    return best.select(*keys, *[F.col("best")[c].alias(c) for c in rest]).select(*rows.columns)


def last_per_key(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The row of each key with the largest position: later writes win."""
    rest = [c for c in rows.columns if c not in keys and c != position]
    best = rows.groupBy(*keys).agg(F.max(F.struct(position, *rest)).alias("best"))
    return best.select(*keys, *[F.col("best")[c].alias(c) for c in (position, *rest)]).select(*rows.columns)


def first_seen_ids(rows: DataFrame, value: str, position: str, name: str = "id") -> DataFrame:
    """value and a dense id in order of first appearance.

    Ids come from ranges: rows are sorted into ranges, counted per range, and
    each range adds what the ranges before it hold. No range meets in one task.
    """
    seen = rows.groupBy(value).agg(F.min(position).alias("_seen"))
    return dense_rank_over_ranges(seen, ["_seen", value], name).select(value, name)


def dense_rank_over_ranges(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """rows with a 0-based number in the total order of `order`, without one task for all rows."""
    return running_total(rows, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def running_total(rows: DataFrame, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount up to and with each row, in the total order of `order`.

    Rows are sorted into ranges and summed up inside each; every range then
    adds what the ranges before it hold. The ranges are written down before
    they are summed, as a second evaluation could cut them elsewhere. Rows that
    are equal in `order` follow each other in any order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).withColumns({"_part": F.spark_partition_id(), "_amount": amount.cast("long")})
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = settled(placed.withColumn("_inside", F.sum("_amount").over(inside)))
    sizes = placed.groupBy("_part").agg(F.sum("_amount").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_amount", "_inside", "_base")


def rank_in_groups(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str, size: str | None = None) -> DataFrame:
    """rows with a 0-based number in their group's order, and the group's size; a group may span many ranges."""
    numbered = dense_rank_over_ranges(rows, [*groups, *order], "_number")
    first = numbered.groupBy(*groups).agg(F.min("_number").alias("_first"), F.count("*").alias("_size"), F.count("*").alias("_rows"))
    joined = join_facts(numbered, first, groups, "_rows")
    return joined.select(*rows.columns, (F.col("_number") - F.col("_first")).alias(name), *([F.col("_size").alias(size)] if size else []))


#: Distinct values of all groups up to which one task a group may hold its counts.
FEW_VALUES = 1_000_000


def quantiles(rows: DataFrame, groups: Sequence[str], value: str, shares: Mapping[str, float], size: str | None = None) -> DataFrame:
    """One row per group with its exact quantiles, interpolated linearly, under the names of shares; nulls are left out.

    size names a column for how many values a group has.

    From counts per distinct value, which are written down. While there are
    FEW_VALUES of them at most, a group's counts fit into a task; beyond that
    their running total over ranges tells the same, and no group is ever held in
    one task. Without groups it is one row for the whole table.
    """
    counts = settled(rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_v")).agg(F.count("*").alias("_k")))
    if counts.count() <= FEW_VALUES:
        at = F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares.values()]), F.col("_k"))
        few = counts.groupBy(*groups).agg(at.alias("_q"), F.sum("_k").alias("_n"))
        return few.select(*groups, *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(shares)], *([F.col("_n").alias(size)] if size else []))
    up = running_total(counts, [*groups, "_v"], F.col("_k"), "_all")
    ends = up.groupBy(*groups).agg(F.min(F.col("_all") - F.col("_k")).alias("_first"), F.sum("_k").alias("_n"), F.count("*").alias("_rows"))
    if groups:
        up = join_facts(up, ends, groups, "_rows")
    else:
        up = up.crossJoin(F.broadcast(ends))  # one row
    upto = F.col("_all") - F.col("_first")
    found = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_n") - 1)
        found.append(F.min(F.when(upto > F.floor(at), F.col("_v"))).alias(f"_low_{name}"))
        found.append(F.min(F.when(upto > F.ceil(at), F.col("_v"))).alias(f"_high_{name}"))
        found.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    picked = up.groupBy(*groups).agg(*found, F.max("_n").alias("_n"))
    value_of = lambda n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")
    return picked.select(*groups, *[value_of(n).alias(n) for n in shares], *([F.col("_n").alias(size)] if size else []))


def ordered_distinct(rows: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position of their first row."""
    return rows.groupBy(value).agg(F.min(position).alias(position))


def on_distinct(rows: DataFrame, value: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute columns once per distinct value and join them back; compute gets and returns a column named value."""
    return rows.join(compute(rows.select(value).distinct()), value, "left")


def attach_by_position(rows: DataFrame, values: DataFrame, position: str) -> DataFrame:
    """Columns of values on the rows with the same position; others get null."""
    return rows.join(values, position, "left")


def attach_if_single(facts: DataFrame, candidates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """value of the only candidate with the keys; null where there is none or more than one."""
    single = candidates.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_other"))
    return facts.join(single.where(F.col(value) == F.col("_other")).drop("_other"), list(keys), "left")


def attach_sequence(facts: DataFrame, by_id: DataFrame, by_pair: DataFrame, ids: str, pair: Sequence[str]) -> DataFrame:
    """sequence by id; two ids count if their sequences are equal; else by pair with a single candidate.

    ids is a space-separated list of at most two names. Rows that lack an id are
    spread over keys of their own, which no id has.
    """
    named = facts.withColumn("_ids", F.split(ids, " "))
    for i in (0, 1):
        named = named.withColumn(f"_id{i}", F.get("_ids", F.lit(i)))
        lacking = F.concat(F.lit("\n"), F.xxhash64(*(F.col(c) for c in facts.columns)).cast("string"))
        named = named.withColumn(f"_key{i}", F.coalesce(F.nullif(F.col(f"_id{i}"), F.lit("")), lacking))
        known = by_id.where("id != ''").select(F.col("id").alias(f"_key{i}"), F.col("sequence").alias(f"_s{i}"))
        named = named.join(known, f"_key{i}", "left").drop(f"_key{i}")
    own = F.when(F.col("_id1").isNull() | (F.col("_s0") == F.col("_s1")), F.col("_s0"))
    named = named.withColumn("_own", own)
    found = attach_if_single(named, by_pair, pair, "sequence")
    return found.withColumn("sequence", F.coalesce("_own", "sequence")).drop("_ids", "_id0", "_id1", "_s0", "_s1", "_own")


#: A list of parts with more rows is not broadcast.
MOST_PARTS = 10_000


def contained_in(left: DataFrame, right: DataFrame, text: str, part: str, position: str, missing: str = "*") -> DataFrame:
    """For each text the first row of right, by position, whose part it contains anywhere, else missing; case is folded.

    Each distinct text is looked at once. right is a name list: its size is
    checked, and up to MOST_PARTS rows go to every task as one array. A longer
    list meets the texts over the part's first three letters, which every text
    that contains it has too; parts shorter than that stay in the array.
    """
    texts = left.select(text).distinct()
    names = right.select(F.col(position).alias("position"), F.col(part).alias("part"), F.lower(part).alias("low"))
    few = names
    if right.limit(MOST_PARTS + 1).count() > MOST_PARTS:
        few = names.where(F.length("low") < 3)
        spans = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 2)), lambda i: F.substring(F.lower(text), i, F.lit(3)))
        heads = texts.select(text, F.explode(F.array_distinct(spans)).alias("_head"))
        long = heads.join(names.where(F.length("low") >= 3).withColumn("_head", F.substring("low", 1, 3)), "_head")
        long = long.where(F.contains(F.lower(text), F.col("low"))).groupBy(text).agg(F.min(F.struct("position", "part")).alias("_hit"))
    listed = few.agg(F.array_sort(F.collect_list(F.struct("position", "part", "low"))).alias("_parts"))
    first = F.get(F.filter("_parts", lambda p: F.contains(F.lower(text), p["low"])), F.lit(0))
    hits = texts.crossJoin(F.broadcast(listed)).select(text, F.struct(first["position"].alias("position"), first["part"].alias("part")).alias("_hit"))  # one row on the right
    hits = hits.where("_hit.position is not null")
    if few is not names:
        hits = hits.union(long).groupBy(text).agg(F.min("_hit").alias("_hit"))
    found = hits.select(text, F.col("_hit.part").alias(part))
    return left.join(found, text, "left").withColumn(part, F.coalesce(part, F.lit(missing)))


def override(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], value: str, source: str = "source", guard: str | None = None
) -> DataFrame:
    """value of the first matching fact, by its position, where there is one, and where it comes from.

    With guard, a column of both, a fact counts only where it agrees: facts
    that do not are left out before the first is taken, or a stale one would hide the right one.
    """
    on = [*keys, *([guard] if guard else [])]
    first = first_per_key(facts, on, ["position"]).select(*on, F.col(value).alias("_fact"))
    return rows.join(first, on, "left").withColumns(
        {
            value: F.coalesce("_fact", value),
            source: F.when(F.col("_fact").isNotNull(), "experiment").when(F.col(value).isNotNull(), "prediction"),
        }
    ).drop("_fact").select(*rows.columns, source)


def misses(keys: DataFrame, cache: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that a cache does not have."""
    return keys.join(cache, list(on), "left_anti")


def unseen(test: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of test in which at least one of the columns has a value that train never has; a null is a value never seen."""
    marks = test
    for i, c in enumerate(columns):
        marks = marks.join(train.select(c).distinct().withColumn(f"_seen{i}", F.lit(True)), c, "left")
    new = F.lit(False)
    for i in range(len(columns)):
        new = new | F.col(f"_seen{i}").isNull()
    return marks.where(new).select(*test.columns)


def conflicts(new: DataFrame, old: DataFrame) -> DataFrame:
    """Class of each row (id, seq) of new against old: same, id_conflict, seq_conflict or new."""
    by_id = old.select("id", F.col("seq").alias("_seq"))
    by_seq = old.groupBy("seq").agg(F.min("id").alias("_id"))
    joined = new.join(by_id, "id", "left").join(by_seq, "seq", "left")
    kind = (
        F.when(F.col("_seq") == F.col("seq"), "same")
        .when(F.col("_seq").isNotNull(), "id_conflict")
        .when(F.col("_id").isNotNull(), "seq_conflict")
        .otherwise("new")
    )
    return joined.select("id", "seq", kind.alias("class"))


def preferred_order(rows: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns that exist, then all others."""
    have = [c for c in first if c in rows.columns]
    return rows.select(*have, *[c for c in rows.columns if c not in have])


def inserted_front(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """rows with new columns before all others; a column of the same name is replaced."""
    return rows.select(*[c.alias(n) for n, c in columns.items()], *[c for c in rows.columns if c not in columns])


def row_numbers(rows: DataFrame, position: str, name: str = "row_num") -> DataFrame:
    """rows with a number from 1 in order of position."""
    return dense_rank_over_ranges(rows, [position], name).withColumn(name, F.col(name) + 1)


def named_or_default(rows: DataFrame, names: DataFrame, keys: Sequence[str], value: str, default: str | None = "") -> DataFrame:
    """value by keys; the default where there is none, or, if that is null, only rows that have one."""
    if default is None:
        return rows.join(names.where(F.col(value).isNotNull()), list(keys))
    return rows.join(names, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(default)))


def completed(rows: DataFrame, parts: Sequence[tuple[DataFrame, Sequence[str], str]], name: str = "complete") -> DataFrame:
    """rows with a feature from each part (table, keys, feature) and whether all are there."""
    for part, keys, feature in parts:
        rows = rows.join(part.select(*keys, feature), list(keys), "left")
    whole = F.lit(True)
    for _, _, feature in parts:
        whole = whole & F.col(feature).isNotNull()
    return rows.withColumn(name, whole)


def recoded(value: Column, mapping: Mapping[str, str]) -> Column:
    """value by a fixed map; null where it has none."""
    entries = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(entries, value)


def regrouped(rows: DataFrame, key: str, position: str, value: str, separator: str = ";") -> DataFrame:
    """One row per key with its values joined in order of position."""
    ordered = F.array_sort(F.collect_list(F.struct(position, F.col(value).cast("string").alias("_v"))))
    return rows.groupBy(key).agg(ordered.alias("_l")).select(
        key, F.array_join(F.transform("_l", lambda s: s["_v"]), separator).alias(value)
    )
