"""Near-duplicate groups by an LSH forest over MinHash signatures.

Each document with shingles has several short signatures, one per tree. The
rows (tree, signature) are put in one global sorted order, cut into even
ranges whatever the keys. In that order, the rows that share the longest prefix
stand next to each other, so looking back over a window of neighbours takes
shallow prefixes where a region is thin and only deep ones where it is dense:
no bucket is ever expanded into its pairs. Signature agreement prunes
neighbours, and every link is confirmed on the full shingle sets.

Documents with equal shingle sets are one class from the start. A first walk
links each row with its most similar earlier neighbour. The depth of a region
then follows its size: where the rows of a shallow prefix fit into the
look-back, the second walk meets all their pairs in different components. In
denser regions, and those that a range's end has cut, a row that is thinly
surrounded in almost all other trees meets the neighbours of a deeper prefix.
Rows that are in dense regions of several trees are crowded and go down to
single shingles: a prefix-filter join on the rarest of them meets every pair at
the threshold, again only between different components.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolith.llm.shared import forget, join_by_key, settle, utf8_rows

WORDS = 5
PERCENT = 75
TREES = 18
DEPTH = 4
SHALLOWEST = 2
DEEPER = 3
WINDOW = 64
#: A row may be in so many dense regions, of TREES, before it is looked at by single shingles: 16 trees remain for each pair.
DENSE_TREES = 2
#: Values of a signature; the trees take the first ones, all leave one bit each as marks.
HASHES = 1024
MARK_BYTES = HASHES // 8
#: Of HASHES marks. Marks of a pair at the threshold agree in 896 on average, with a deviation of 10.6: at 838, or
#: 5.5 deviations, one pair in 5e7 is lost.
LEAST_AGREEING = 838
#: Rows that meet over single shingles are compared by more marks: their like come in great numbers just below the threshold.
WIDE_HASHES, WIDE_AGREEING = 4096, 3468
#: First shingles of a prefix that go along, so that a pair is looked at over its first common shingle only.
HEAD = 32
#: For the first walk, which only wants links that are likely; the second walk and the join take the rest.
LIKELY_AGREEING = 875
#: Links of a document, over all trees, that the first walk confirms; the second walk takes all it has left apart.
FIRST_LINKS = 4
ROWS_A_RANGE = 60_000
#: Rows of a shingle's list that are compared at a time; longer lists are cut into blocks, and each two blocks meet.
BLOCK_ROWS = 1024
#: The most frequent shingles of crowded rows, which come last in the order of prefixes. The order only sets the costs.
FREQUENT = 200_000

_TABLE = np.random.default_rng(20_260_101)
_BYTE = _TABLE.integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_PLACE = _TABLE.integers(0, 2**64, WORDS, np.uint64) | np.uint64(1)
_A = _TABLE.integers(0, 2**32, WIDE_HASHES, np.uint32) | np.uint32(1)
_B = _TABLE.integers(0, 2**32, WIDE_HASHES, np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_STEP), -1, 2**64))
    steps = np.full(size, _STEP)
    back = np.full(size, inverse)
    steps[0] = back[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(back)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    gaps = np.concatenate(([True], _SPACE[raw], [True]))
    edges = np.flatnonzero(gaps[1:] != gaps[:-1])
    starts, ends = edges[::2], edges[1::2]
    steps, back = _powers(1 << max(12, int(len(raw)).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[raw]] * steps[: len(raw)])))
    return _mix((sums[ends] - sums[starts]) * back[starts])


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; all words as one if there are fewer."""
    hashed = word_hashes(text or b"")
    n = len(hashed)
    if n == 0:
        return hashed
    width = min(n, words)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += hashed[i : n - width + 1 + i] * _PLACE[i]
    # a whole text of fewer words never equals a shingle
    return np.unique(_mix(total + np.uint64(width)))


def signature(found: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values of a set of hashes."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    one, two = _A[:hashes], _B[:hashes]
    least = np.full(hashes, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 64):
        part = low[i : i + 64, None] * one
        part += two
        np.minimum(least, part.min(axis=0), out=least)
    return least


def packed_marks(values: np.ndarray) -> bytes:
    """One bit of each value of a signature, after mixing: the values' own low bits are linear in the shingle's."""
    mixed = (values ^ (values >> np.uint32(16))) * np.uint32(0x7FEB352D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x846CA68B)
    return np.packbits((mixed >> np.uint32(31)).astype(bool)).tobytes()


def agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many marks rows of packed marks agree."""
    differ = np.ascontiguousarray(one ^ two).view(np.uint64)
    return 8 * one.shape[-1] - np.bitwise_count(differ).sum(axis=1, dtype=np.int64)


def names_of(found: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a shingle set."""
    mixed = _mix(found + np.uint64(0x51ED270B7F4A7C15))
    return int(found.sum(dtype=np.uint64)) - 2**63, int(mixed.sum(dtype=np.uint64)) - 2**63


def set_table(docs: DataFrame, key: str) -> DataFrame:
    """key, n_shingles, the set's 128-bit name (name_a, name_b), signature bytes and marks."""

    def describe(batches):
        import pyarrow as pa

        forget()
        for batch in batches:
            n, a, b, sig, marks = [], [], [], [], []
            for (text,) in utf8_rows(batch, "text"):
                found = shingles(text)
                n.append(len(found))
                name_a, name_b = names_of(found)
                a.append(name_a)
                b.append(name_b)
                if len(found):
                    values = signature(found)
                    sig.append(values[: TREES * DEPTH].astype(">u4").tobytes())
                    marks.append(packed_marks(values))
                else:
                    sig.append(None)
                    marks.append(None)
            keys = batch.column(batch.schema.get_field_index("key"))
            long, binary = pa.int64(), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(n, long), pa.array(a, long), pa.array(b, long), pa.array(sig, binary), pa.array(marks, binary)],
                names=["id", "n_shingles", "name_a", "name_b", "sig", "marks"],
            )

    light = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return light.mapInArrow(
        describe, "id long, n_shingles long, name_a long, name_b long, sig binary, marks binary"
    )


def _fixed(batch, name: str, width: int) -> np.ndarray:
    joined = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(joined, np.uint8).reshape(-1, width)


def _whole(batches):
    """All rows of one range as one batch; ranges have about ROWS_A_RANGE rows."""
    import pyarrow as pa

    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held and sum(len(b) for b in held) else None


def _region(batch, depth: int = SHALLOWEST) -> np.ndarray:
    """One value a row: tree and prefix."""
    place = _fixed(batch, "place", 1 + 4 * DEPTH)
    name = place[:, 0].astype(np.uint64)
    for i in range(depth):
        value = np.ascontiguousarray(place[:, 1 + 4 * i : 5 + 4 * i]).view(np.uint32)[:, 0]
        name = _mix(name * np.uint64(2**32) + value)
    return name


def _runs(region: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
    return starts, np.diff(np.append(starts, len(region)))


def _agreeing(marks: np.ndarray, n: np.ndarray, later: np.ndarray, back: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of later whose row `back` before may be a link, and how many marks agree."""
    earlier = later - back
    low, high = np.minimum(n[later], n[earlier]), np.maximum(n[later], n[earlier])
    later = later[100 * low >= PERCENT * high]
    same = agreeing(marks[later], marks[later - back])
    fit = same >= least
    return later[fit], same[fit]


def first_walk(rows: DataFrame) -> DataFrame:
    """Rows that share a region with a neighbour, each with its most similar earlier one, and whether the region is dense.

    A region counts as dense, too, if a range's end may have cut it.
    """

    def walk(batches):
        import pyarrow as pa

        batch = _whole(batches)
        if batch is None:
            return
        region, marks = _region(batch), _fixed(batch, "marks", MARK_BYTES)
        ids = batch.column(batch.schema.get_field_index("id")).to_numpy()
        n = batch.column(batch.schema.get_field_index("n_shingles")).to_numpy()
        most, best = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        for back in range(1, min(WINDOW, len(ids) - 1) + 1):
            later = np.flatnonzero(region[back:] == region[:-back]) + back
            if not len(later):
                break
            later, same = _agreeing(marks, n, later, back, LIKELY_AGREEING)
            better = same > most[later]
            most[later[better]], best[later[better]] = same[better], later[better] - back
        _, sizes = _runs(region)
        dense = sizes > WINDOW + 1
        dense[[0, -1]] |= sizes[[0, -1]] > 1
        live = np.zeros(len(ids), bool)
        live[[0, -1]] = True  # the next range may go on with the same region
        alike = region[1:] == region[:-1]
        live[1:] |= alike
        live[:-1] |= alike
        kept = pa.array(np.flatnonzero(live))
        other = pa.array(ids[best], pa.int64(), mask=best < 0)
        more = [*batch.columns, other, pa.array(most, pa.int64()), pa.array(np.repeat(dense, sizes))]
        yield pa.RecordBatch.from_arrays(more, names=[*batch.schema.names, "other", "same", "dense"]).take(kept)

    return rows.mapInArrow(walk, "place binary, id long, n_shingles long, marks binary, other long, same long, dense boolean")


def second_walk(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that may be links, and crowded rows.

    rows are those of the first walk with component and trees, in how many of
    which they are in a dense region. A crowded row is (a, null), if its region
    has more than one component. A region that a range's end may have cut gives
    (a, null, region, component), for crowded() to put together.
    """

    def walk(batches):
        import pyarrow as pa

        batch = _whole(batches)
        if batch is None:
            return
        region, deeper, marks = _region(batch), _region(batch, DEEPER), _fixed(batch, "marks", MARK_BYTES)
        of = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        ids, n, own, known, trees = of("id"), of("n_shingles"), of("component"), of("dense"), of("trees")
        long = pa.int64()

        def some(a, b=None, place=None, component=None):
            columns = [pa.nulls(len(a), long) if c is None else pa.array(c, long) for c in (a, b, place, component)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "region", "component"])

        starts, sizes = _runs(region)
        dense, mixed = sizes > WINDOW + 1, np.minimum.reduceat(own, starts) < np.maximum.reduceat(own, starts)
        cut = np.zeros(len(sizes), bool)
        cut[[0, -1]] = True
        free = known & (trees <= DENSE_TREES)  # all other regions of these rows are thin
        at_end = np.repeat(cut, sizes) & ~free
        yield some(ids[at_end], None, region[at_end].view(np.int64), own[at_end])
        yield some(np.unique(ids[np.repeat(dense & mixed & ~cut, sizes) & ~free]))
        thin = np.repeat(~dense & ~cut, sizes)
        for back in range(1, min(WINDOW, len(ids) - 1) + 1):
            later = np.flatnonzero(region[back:] == region[:-back]) + back
            if not len(later):
                break
            later = later[own[later] != own[later - back]]
            near = (deeper[later] == deeper[later - back]) & (free[later] | free[later - back])
            later, _ = _agreeing(marks, n, later[thin[later] | near], back, LEAST_AGREEING)
            if len(later):
                one, two = ids[later], ids[later - back]
                yield some(np.maximum(one, two), np.minimum(one, two))

    return rows.mapInArrow(walk, "a long, b long, region long, component long")


def crowded(walked: DataFrame) -> DataFrame:
    """id of the crowded rows of second_walk()."""
    cut = walked.where("region is not null").select("region", "component", F.col("a").alias("id"))
    mixed = cut.groupBy("region").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    )
    cut = join_by_key(cut, mixed.where("low < high").select("region", "size"), ["region"], "size", cut.count())
    return walked.where("b is null and region is null").select(F.col("a").alias("id")).union(cut.select("id")).distinct()


def in_order(rows: DataFrame, ranges: int) -> DataFrame:
    """Sort over all rows; place comes first, so equal prefixes stand together, and id makes every key divisible."""
    return rows.repartitionByRange(ranges, "place", "marks", "id").sortWithinPartitions("place", "marks", "id")


def confirmed(edges: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The edges (a, b) whose full shingle sets have the similarity asked for."""
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # the ends of links grow with the corpus: merge joins at every size, never a broadcast
    texts = settle(texts.join(ends.hint("merge"), "id", "left_semi"), "texts", "zstd")

    def confirm(batches):
        import pyarrow as pa

        known: tuple = (None, None)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2)), *(batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)), strict=True)
            kept = []
            for a, b, text_a, text_b in rows:
                if known[0] != (b, len(text_b)):
                    known = ((b, len(text_b)), shingles(text_b))
                one, two = shingles(text_a), known[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= PERCENT * (len(one) + len(two) - both):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in kept], pa.int64()) for i in range(2)], names=["a", "b"]
            )

    pairs = edges.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    pairs = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a > b): the smallest id it is connected with.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until nothing changes; the number of rounds grows with the logarithm
    of the longest path. Centres of large stars are joined apart.
    """
    before, total = None, edges.count()
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size"))
        large = join_by_key(both, least, ["u"], "size", 2 * total)
        large = large.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size"))
        rest = join_by_key(large, low, ["a"], "size", total).where("b > m")
        rest = rest.select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(rest.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, total = now, now[0]
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Up to FREQUENT shingles that repeat within batches, sorted, and about how often they come."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found = [shingles(t) for (t,) in utf8_rows(batch, "text")]
            names, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array(n[often])], names=["shingle", "n"])

    counts = texts.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    names, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(names)
    return names[order], n[order]


def prefix_lengths(n: int) -> tuple[int, int]:
    """How many of a set's first shingles a link needs, with a set that is not smaller and with one that is not larger.

    A link shares at least 6/7 of the smaller set and 3/4 of the larger one.
    """
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1, n - -(-PERCENT * n // 100) + 1


def prefixes(texts: DataFrame) -> DataFrame:
    """shingle, place, id, name_a, component, n_shingles and short for each shingle of a set's prefix, rare ones first.

    texts has id, component and text. Any two sets at the threshold have a
    common shingle in the short prefix of the smaller and the whole of the larger.
    """
    often = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts))

    def cut(batches):
        import pyarrow as pa

        names, n = often.value
        for batch in batches:
            out = []
            for key, component, text in utf8_rows(batch, "id", "component", "text"):
                found = shingles(text)
                at = np.minimum(np.searchsorted(names, found), max(0, len(names) - 1))
                weight = np.where(names[at] == found, n[at], 0) if len(names) else np.zeros(len(found), np.int64)
                short, whole = prefix_lengths(len(found))
                first = found[np.lexsort((found, weight))[:whole]].view(np.int64).tolist()
                name_a = names_of(found)[0]
                out += [(s, i, key, name_a, component, len(found), i < short) for i, s in enumerate(first)]
            kinds = (*[pa.int64()] * 6, pa.bool_())
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["shingle", "place", "id", "name_a", "component", "n_shingles", "short"],
            )

    return texts.select("id", "component", "text").mapInArrow(
        cut, "shingle long, place long, id long, name_a long, component long, n_shingles long, short boolean"
    )


def wide_marks(texts: DataFrame) -> DataFrame:
    """id, name_a and WIDE_HASHES marks of texts with id and text."""

    def describe(batches):
        import pyarrow as pa

        for batch in batches:
            ids, names, marks = [], [], []
            for key, text in utf8_rows(batch, "id", "text"):
                found = shingles(text)
                ids.append(key)
                names.append(names_of(found)[0])
                marks.append(packed_marks(signature(found, WIDE_HASHES)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(marks, pa.binary())], names=["id", "name_a", "marks"]
            )

    return texts.select("id", "text").mapInArrow(describe, "id long, name_a long, marks binary")


def heads(rows: DataFrame) -> DataFrame:
    """id, name_a and head: the first HEAD shingles of each prefix in order, as many as there are."""
    first = F.array_sort(F.collect_list(F.struct("place", "shingle")))  # HEAD at most
    found = rows.where(F.col("place") < HEAD).groupBy("id", "name_a").agg(first.alias("f"))
    return found.select("id", "name_a", F.transform("f", lambda s: s["shingle"]).alias("head"))


def _met(ids, n, own, marks, short, side, place, head) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of a group: pairs of the two sides (or of one, with itself), in different components, that may be links."""
    apart = bool(len(side)) and side[0] != side[-1]
    looked = np.arange(len(ids))
    if apart:
        sides = np.flatnonzero(side == side[0]), np.flatnonzero(side == side[-1])
        looked = min(sides, key=len)
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in looked:
        fit = (own != own[i]) & np.where(n > n[i], short[i], np.where(n < n[i], short, short | short[i]))
        fit &= (100 * n[i] >= PERCENT * n) & (100 * n >= PERCENT * n[i])
        fit &= side != side[i] if apart else ids > ids[i]
        other = np.flatnonzero(fit)
        if len(other):
            other = other[agreeing(marks[other], marks[i]) >= WIDE_AGREEING]
        before = head[i, : place[i]]
        if len(other) and len(before):
            # a common shingle further in front: the pair meets there as well, and is looked at there
            met = np.isin(head[other], before) & (np.arange(HEAD) < place[other, None])
            other = other[~met.any(axis=1)]
        ones.append(np.full(len(other), ids[i]))
        twos.append(ids[other])
    return np.concatenate(ones), np.concatenate(twos)


def in_blocks(rows: DataFrame) -> DataFrame:
    """prefixes() rows of lists with more than one component, once per group (shingle, i, j) of two blocks that meet.

    Most rows of a list are often of one component already, its main one. They
    are cut into blocks that meet the blocks of all others, and the others'
    blocks meet each other too; rows of the main component never meet. side
    tells the two blocks of a group apart.
    """
    per = rows.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    lists = per.groupBy("shingle").agg(
        F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), F.max("short").alias("short")
    )
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    lists = lists.where(F.col("short") & (F.col("size") > F.col("main.n"))).select(
        "shingle",
        "size",
        F.col("main.component").alias("main"),
        blocks(F.col("main.n")).alias("mains"),
        blocks(F.col("size") - F.col("main.n")).alias("others"),
    )
    rows = join_by_key(rows, lists, ["shingle"], "size", rows.count()).withColumn("is_main", F.col("component") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    group = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    b, mains = F.col("block"), F.col("mains")
    meets_others = F.transform(upto(F.col("others")), lambda y: group(b, y, F.lit(0)))
    meets_main = F.transform(upto(mains), lambda x: group(x, b, F.lit(1)))
    each_other = F.transform(upto(F.col("others")), lambda y: group(mains + F.least(b, y), F.greatest(b, y), b))
    groups = F.when(F.col("is_main"), meets_others).otherwise(F.concat(meets_main, each_other))
    return rows.select("shingle", "place", "id", "name_a", "component", "n_shingles", "short", F.inline(groups))


def crowd_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of in_blocks() rows, with wide marks and heads, that meet in a group and may be links."""
    group = ["shingle", "i", "j"]

    def compare(batches):
        import pyarrow as pa

        names = ("id", "n_shingles", "component", "short", "side", "place")

        def pairs(table, whole: bool):
            """Links of the groups in sorted rows, and where the last group begins unless the rows are whole."""
            keys = np.stack([table[c].to_numpy() for c in group])
            columns = [table[c].to_numpy() for c in names]
            marks = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint8).reshape(-1, WIDE_HASHES // 8)
            known = table["head"].combine_chunks()
            counts = np.diff(known.offsets.to_numpy())
            head = np.zeros((len(marks), HEAD), np.int64)
            head[np.arange(HEAD) < counts[:, None]] = known.flatten().to_numpy()
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
            ends = [*starts[1:], len(marks)]
            ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, end in zip(starts if whole else starts[:-1], ends):
                if end - at > 1:
                    ids, n, own, short, side, place = (c[at:end] for c in columns)
                    one, two = _met(ids, n, own, marks[at:end], short, side, place, head[at:end])
                    ones.append(one)
                    twos.append(two)
            one, two = np.concatenate(ones), np.concatenate(twos)
            arrays = [pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))]
            return pa.RecordBatch.from_arrays(arrays, names=["a", "b"]), starts[-1]

        held: list = []
        for batch in batches:
            if len(batch):
                table = pa.Table.from_batches([*held, batch])
                found, rest = pairs(table, False)
                held = table.slice(rest).to_batches()
                yield found
        if held:
            yield pairs(pa.Table.from_batches(held), True)[0]

    spread = rows.repartition(*group).sortWithinPartitions(*group, "side", "id")
    return spread.mapInArrow(compare, "a long, b long").distinct()


def merged_by(links: DataFrame, found: DataFrame) -> DataFrame:
    """(component, final) of the components in found that links (a, b) between ids connect."""
    for end in ("a", "b"):
        at = found.select(F.col("id").alias(end), F.col("component").alias(f"at_{end}"))
        links = links.join(at, end, "left").withColumn(f"at_{end}", F.coalesce(f"at_{end}", end))
    links = links.select(F.greatest("at_a", "at_b").alias("a"), F.least("at_a", "at_b").alias("b")).where("a != b")
    merged = components(settle(links.distinct(), "cross-links"))
    return merged.select(F.col("id").alias("component"), F.col("component").alias("final"))


def renamed(ids: DataFrame, merged: DataFrame) -> DataFrame:
    """ids with components replaced by what they are merged into; a component may hold most of the rows."""
    size = ids.groupBy("component").agg(F.count("*").alias("_size"))
    names = merged.join(size, "component")
    out = join_by_key(ids, names, ["component"], "_size", ids.count(), "left")
    return out.withColumn("component", F.coalesce("final", "component")).drop("final")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a set holds the
    distinct shingles of five words, or all words as one if there are fewer.
    Two documents are linked when 100 * intersection >= 75 * union;
    component_id is the smallest key a document reaches over links, and kept
    tells whether it is its own. Null, empty and blank texts have no shingles
    and no links. Rows with equal keys are one document for linking; a row with
    a null key has only the links of an equal shingle set. Other columns are
    ignored; an empty table gives an empty result. key is integer.
    """
    sets = settle(set_table(docs, key), "sets")
    name = ["n_shingles", "name_a", "name_b"]
    some = sets.where("n_shingles > 0")
    classes = settle(some.groupBy(*name).agg(F.min("id").alias("id"), F.count("*").alias("size")), "class-names")
    kept = some.join(classes.select("id", *name), ["id", *name], "left_semi").dropDuplicates(["id", *name])
    kept = settle(kept, "class-sets")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = kept.select("id", "n_shingles", "sig", "marks", tree.alias("tree")).select(
        F.concat(
            F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.substring("sig", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))
        ).alias("place"),
        "id",
        "n_shingles",
        "marks",
    )
    ranges = max(12, -(-kept.count() * TREES // ROWS_A_RANGE))
    live = settle(first_walk(in_order(rows, ranges)), "live")
    nearest = live.where("other is not null and other != id").groupBy("id", "other").agg(F.max("same").alias("same"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("same"), "other"))  # TREES rows an id at most
    nearest = nearest.withColumn("best", best).where(F.col("best") <= FIRST_LINKS)
    edges = nearest.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    found = components(settle(confirmed(settle(edges.distinct(), "edges"), docs, key), "links"))
    found = settle(found, "components")
    trees = live.where("dense").groupBy("id").agg(F.count("*").alias("trees"))
    known = live.drop("other", "same").join(found.join(trees, "id", "full"), "id", "left")
    known = known.withColumns({"component": F.coalesce("component", "id"), "trees": F.coalesce("trees", F.lit(0))})
    # other cuts than before, so that what a range's end has parted meets here
    more = settle(second_walk(in_order(known, ranges + 1)), "cross-edges")
    merged = merged_by(confirmed(more.where("b is not null").select("a", "b").distinct(), docs, key), found)
    ids = classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ids = settle(renamed(settle(ids, "classes"), merged), "classes")
    crowd = crowded(more).join(ids.select("id", "component").distinct(), "id")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.where("text is not null").join(crowd.hint("merge"), "id").distinct()
    texts = settle(texts, "crowd", "zstd")
    first = settle(prefixes(texts), "prefixes")
    met = settle(in_blocks(first), "blocks")
    some = texts.join(met.select("id").distinct().hint("merge"), "id", "left_semi")
    met = met.join(settle(wide_marks(some), "wide-marks"), ["id", "name_a"]).join(heads(first), ["id", "name_a"])
    rest = settle(crowd_pairs(met), "crowd-edges")
    ids = renamed(ids, merged_by(confirmed(rest, docs, key), ids.select("id", "component").distinct()))
    ids = settle(ids.select(*name, F.col("component").alias("component_id"), "size"), "class-components")
    own = join_by_key(sets.where("n_shingles > 0").select("id", *name), ids, name, "size", sets.count())
    none = sets.where("n_shingles = 0").select("id", *name, F.col("id").alias("component_id"))
    own = own.union(none).withColumn("component_id", F.coalesce("component_id", "id"))
    return own.select(
        F.col("id").alias(key), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
