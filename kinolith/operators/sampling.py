"""Folds, splits, balancing and weights; every choice is a hash of a key, so reruns agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.functions import maths
from kinolith.operators.assembly import dense_rank_over_ranges, rank_in_groups
from kinolith.operators.staging import join_facts, settled


def hashed(key: Column, seed: int = 42) -> Column:
    """0..999982 from a key, the same in any engine with 64-bit integers."""
    return F.pmod(key.cast("long") * 7919 + seed * 104729, F.lit(999_983))


def folds(rows: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """rows with fold 0..k-1; rows of one key stay together."""
    return rows.withColumn("fold", (hashed(F.col(key), seed) % k).cast("int"))


def fold_plan(sizes: Sequence[tuple[int, int]], k: int) -> dict[int, list[tuple[int, list[int]]]]:
    """For each size of (size, number of groups), largest first: (first rank, folds in turn) of each stretch of ranks.

    Greedy: the next group goes to the fold with the fewest rows, the lower one
    of equals. Groups of one size fill the folds in turns between the points
    where another fold comes level, so a size has at most k stretches, however
    many groups it has.
    """
    load = [0] * k
    plan: dict[int, list[tuple[int, list[int]]]] = {}
    for size, groups in sorted(sizes, reverse=True):
        done, stretches = 0, []
        for active in range(1, k + 1):
            order = sorted(range(k), key=lambda f: (load[f], f))
            turns = order[:active]
            room = groups - done
            if active < k:
                edge = (load[order[active]], order[active])
                # how often each fold can still come before the next one's place
                fits = [-(-(edge[0] - load[f]) // size) + (load[f] + -(-(edge[0] - load[f]) // size) * size == edge[0] and f < edge[1]) for f in turns]
                room = min(room, sum(fits))
            if room > 0:
                stretches.append((done, turns))
                for i, f in enumerate(turns):
                    load[f] += size * (room // active + (i < room % active))
                done += room
        plan[size] = stretches
    return plan


def balanced_folds(rows: DataFrame, group: str, k: int = 5) -> DataFrame:
    """rows with fold 0..k-1, the rows of a group together, folds as even as greedy filling makes them.

    The largest group first, equal ones in order of their keys, each to the fold
    with the fewest rows so far, the lower one of equals. Only the histogram of
    group sizes goes to the driver, which has fewer rows than the root of twice
    the table's. Rows without a group are a group.
    """
    sizes = settled(rows.groupBy(group).agg(F.count("*").alias("_held")))
    counted = [(r["_held"], r["n"]) for r in sizes.groupBy("_held").agg(F.count("*").alias("n")).collect()]
    stretches = [(size, start, turns) for size, parts in fold_plan(counted, k).items() for start, turns in parts]
    plan = rows.sparkSession.createDataFrame(stretches, "_held long, start long, turns array<int>")
    plan = plan.groupBy("_held").agg(F.array_sort(F.collect_list(F.struct("start", "turns"))).alias("parts"))
    ranked = rank_in_groups(sizes, ["_held"], [group], "_rank").join(F.broadcast(plan), "_held")  # a row a size
    part = F.element_at(F.filter("parts", lambda p: p["start"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_part", part)
    fold = F.get("_part.turns", ((F.col("_rank") - F.col("_part.start")) % F.size("_part.turns")).cast("int"))
    return join_facts(rows, ranked.select(group, fold.alias("fold"), F.col("_held").alias("_rows")), [group], "_rows")


def split_tags(rows: DataFrame, key: str, train: float = 0.8, dev: float = 0.1, seed: int = 1234) -> DataFrame:
    """rows with part 0 (train), 1 (dev) or 2 (test) by shares of the hash range."""
    share = hashed(F.col(key), seed) / 999_983
    return rows.withColumn("part", F.when(share < train, 0).when(share < train + dev, 1).otherwise(2))


def exact_split(rows: DataFrame, key: str, train: float = 0.8, seed: int = 1234) -> DataFrame:
    """rows with train = true for exactly floor(train * n) of them, in hash order."""
    placed = dense_rank_over_ranges(rows.withColumn("_h", hashed(F.col(key), seed)), ["_h", key], "_r")
    n = rows.count()
    return placed.withColumn("train", F.col("_r") < int(train * n)).drop("_h", "_r")


def contiguous_fold(rows: DataFrame, position: str, k: int, fold: int) -> DataFrame:
    """Rows of the fold-th of k blocks in order of a dense position."""
    size = max(1, rows.count() // k)
    return rows.where(F.least(F.lit(k - 1), F.floor(F.col(position) / size)) == fold)


def repeated_samples(rows: DataFrame, key: str, share: float, repeats: int) -> DataFrame:
    """Each of several samples of a share of all rows, told apart by repeat."""
    drawn = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.when(hashed(F.col(key) * 31 + r) / 999_983 < share, r)),
        lambda r: r.isNotNull(),
    )
    return rows.withColumn("repeat", F.explode(drawn))


def filled_up(rows: DataFrame, group: str, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """rows several times, so that each group of wanted (group, target) has exactly target rows if it has fewer.

    copy numbers the copies from 1. Every row comes target div n times, and the
    first target mod n rows in order of their hash once more; ranks come from
    ranges, so no group is gathered in one task. Other groups stay as they are.
    """
    ranked = rank_in_groups(rows.withColumn("_h", hashed(F.col(keys[0]))), [group], ["_h", *keys], "_r", "_n")
    sizes = rows.groupBy(group).agg(F.count("*").alias("_rows"))
    ranked = join_facts(ranked, wanted.join(sizes, group), [group], "_rows")
    target = F.greatest(F.col("_n"), F.coalesce("target", F.col("_n")))
    copies = F.floor(target / F.col("_n")) + F.when(F.col("_r") < target % F.col("_n"), 1).otherwise(0)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*rows.columns, "copy")


def oversampled(rows: DataFrame, bin_: str, keys: Sequence[str], factor: float = 2.0) -> DataFrame:
    """Rows of small bins several times, so that each bin has at least factor times the median bin's size, rounded down."""
    counts = rows.groupBy(bin_).agg(F.count("*").alias("_n"))
    target = counts.agg(F.floor(F.percentile("_n", F.lit(0.5)) * factor).cast("long").alias("target"))  # a row a bin goes in
    return filled_up(rows, bin_, keys, counts.select(bin_).crossJoin(F.broadcast(target)))  # one row


def oversampled_bands(rows: DataFrame, band: str, keys: Sequence[str], low: Sequence[float], high: float, factor: float = 0.15) -> DataFrame:
    """Rows of the low bands several times, so that each has factor times the high band's size, or the largest band's if that is empty."""
    counts = rows.groupBy(band).agg(F.count("*").alias("n"))
    of_high = F.max(F.when(F.col(band) == high, F.col("n")))
    target = counts.agg(F.floor(F.coalesce(of_high, F.max("n")) * factor).cast("long").alias("target"))
    return filled_up(rows, band, keys, counts.where(F.col(band).isin(list(low))).select(band).crossJoin(F.broadcast(target)))  # one row


def band_counts(before: DataFrame, after: DataFrame, band: str) -> DataFrame:
    """One row per band: how many rows it has before and after."""
    one = before.groupBy(band).agg(F.count("*").alias("before"))
    two = after.groupBy(band).agg(F.count("*").alias("after"))
    return one.join(two, band, "full").na.fill(0, ["before", "after"])


def halves(rows: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """rows with half = 0 or 1, drawn without replacement; the first has the odd one."""
    placed = dense_rank_over_ranges(rows.withColumn("_h", hashed(F.col(keys[0]), seed)), ["_h", *keys], "_r")
    return placed.withColumn("half", (F.col("_r") % 2).cast("int")).drop("_h", "_r")


def smoothed_density(rows: DataFrame, bin_: str, kernel: Sequence[float] = (0.5, 1.0, 0.5)) -> DataFrame:
    """bin, n, smoothed: counts of consecutive bins, zero where empty, convolved with a three-tap kernel."""
    counts = rows.groupBy(F.col(bin_).alias("bin")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    bins = span.where("a is not null").select(F.explode(F.sequence("a", "b")).alias("bin"))
    full = bins.join(counts, "bin", "left").na.fill(0, ["n"])
    order = Window.orderBy("bin")  # one row per bin
    smooth = kernel[0] * F.lag("n", 1, 0).over(order) + kernel[1] * F.col("n") + kernel[2] * F.lead("n", 1, 0).over(order)
    return full.select("bin", "n", smooth.alias("smoothed"))


def density_weights(rows: DataFrame, bin_: str) -> DataFrame:
    """rows with weight, inverse to the smoothed count of their bin."""
    density = smoothed_density(rows, bin_).select(F.col("bin").alias(bin_), F.lit(1.0) / F.col("smoothed"))
    return rows.join(density.toDF(bin_, "weight"), bin_)


def holdout_groups(rows: DataFrame, group: str, share: float = 0.1) -> DataFrame:
    """rows with test = true for all rows of about a share of the groups."""
    return rows.withColumn("test", hashed(F.col(group)) / 999_983 < share)


def leakage_safe(train: DataFrame, test: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """train without rows of test and without rows similar to them."""
    banned = test.select(key).union(similar.select(key)).distinct()
    return train.join(banned, key, "left_anti")


def beta_pick(key: Column, shape: float, tries: int = 8) -> Column:
    """A Beta(shape, shape) variate from the hash of a key: the first accepted of a few pairs of uniforms."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) + 0.5) / 1_000_000

    pairs = F.array(*[F.struct(F.pow(uniform(2 * i), F.lit(1 / shape)).alias("x"), F.pow(uniform(2 * i + 1), F.lit(1 / shape)).alias("y")) for i in range(tries)])
    fit = F.get(F.filter(pairs, lambda p: (p["x"] + p["y"] <= 1) & (p["x"] + p["y"] > 0)), F.lit(0))
    return F.coalesce(fit["x"] / (fit["x"] + fit["y"]), F.lit(0.5))


def partners(rows: DataFrame, key: str, neighbourhoods: Sequence[Sequence[str]], label: str, tries: int = 4) -> DataFrame:
    """key and partner: another row of one of its neighbourhoods (rows with equal columns), near in label if there is a choice.

    In the hash order of a neighbourhood the next few rows are candidates, met
    by their rank, so a large one is neither listed nor sorted in one task. The
    choice among them is a race with the Gaussian affinity of labels as weight.
    Several neighbourhoods (equal in one column or in another) are united.
    """
    spread = rows.agg(F.stddev_pop(label).alias("_sd"))
    met = None
    for columns in neighbourhoods:
        some = rows.where(F.col(columns[0]).isNotNull()).select(key, label, *columns, hashed(F.col(key)).alias("_h"))
        placed = settled(rank_in_groups(some, columns, ["_h", key], "_r", "_n").drop("_h"))
        asks = placed.where("_n > 1").withColumn("_step", F.explode(F.sequence(F.lit(1), F.least(F.lit(tries), F.col("_n") - 1).cast("int"))))
        asks = asks.select(*columns, F.col(key).alias("_key"), F.col(label).alias("_y"), ((F.col("_r") + F.col("_step")) % F.col("_n")).alias("_r"))
        pairs = asks.join(placed.select(*columns, "_r", F.col(key).alias("partner"), F.col(label).alias("_other")), [*columns, "_r"])
        pairs = pairs.select(F.col("_key").alias(key), "_y", "partner", "_other")
        met = pairs if met is None else met.union(pairs)
    met = met.distinct().crossJoin(F.broadcast(spread))  # one row
    weight = F.when(F.col("_sd") > 0, maths.affinity(F.col("_y") - F.col("_other"), F.col("_sd"))).otherwise(1.0)
    u = (F.pmod(F.xxhash64(key, "partner"), F.lit(1_000_000)) + 0.5) / 1_000_000
    race = -F.log(u) / F.greatest(weight, F.lit(1e-300))
    best = met.groupBy(key).agg(F.min(F.struct(race.alias("race"), "partner")).alias("b"))
    return best.select(key, F.col("b.partner").alias("partner"))


def mixed(rows: DataFrame, key: str, neighbourhoods: Sequence[Sequence[str]], vector: str, label: str, shape: float = 0.4) -> DataFrame:
    """One synthetic row per row that has a partner: key, partner, share, and vector and label mixed by a Beta(shape, shape) share."""
    chosen = partners(rows, key, neighbourhoods, label)
    one = rows.select(key, F.col(vector).alias("_v"), F.col(label).alias("_y"))
    two = rows.select(F.col(key).alias("partner"), F.col(vector).alias("_w"), F.col(label).alias("_z"))
    both = chosen.join(one, key).join(two, "partner").withColumn("share", beta_pick(F.col(key) + F.col("partner") * 17, shape))
    return both.select(
        key,
        "partner",
        "share",
        F.zip_with("_v", "_w", lambda a, b: a * F.col("share") + b * (1 - F.col("share"))).alias(vector),
        (F.col("_y") * F.col("share") + F.col("_z") * (1 - F.col("share"))).alias(label),
    )
