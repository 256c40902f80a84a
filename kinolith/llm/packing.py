"""Packing of token sequences by non-negative least squares over a length histogram.

Documents become pieces: whole windows, then a rest. The histogram of piece
lengths, in bins of a few tokens, is all that the driver sees, and its size is
fixed by the window. There, combinations of up to three bins that fill a window
exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left is packed greedily,
still on the histogram. The resulting table says, for ranks of a bin's pieces,
which sequence and slot they take; pieces find their rank from counts alone.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolith.llm.shared import settle, utf8_rows
from kinolith.llm.token_counts import encoded_rows, encoder

UNIT = 4
SWEEPS = 40


def combinations_filling(window: int, present: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of one to three bins from present, with sum window, largest first."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    found: list[tuple[int, ...]] = [(window,)] if have[window] else []
    for a in (int(x) for x in present[::-1] if x < window):
        rest = window - a
        if rest <= a and have[rest]:
            found.append((a, rest))
        b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
        if len(b):
            b = b[have[b] & have[rest - b]]
            found += [(a, int(x), rest - int(x)) for x in b]
    return found


def repeat_counts(histogram: np.ndarray, strategies: list[tuple[int, ...]], sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares: counts x that bring the sum of strategies near the histogram.

    Coordinate descent; each step is exact in one count, so the residual never
    grows, and it stops when a sweep changes little.
    """
    left = histogram.astype(float).tolist()
    sides = []
    for s in strategies:
        times: dict[int, int] = {}
        for b in s:
            times[b] = times.get(b, 0) + 1
        sides.append((list(times.items()), float(sum(m * m for m in times.values()))))
    order = sorted(range(len(strategies)), key=lambda i: -min(histogram[b] / m for b, m in sides[i][0]))
    x = [0.0] * len(strategies)
    for _ in range(sweeps):
        moved = 0.0
        for i in order:
            terms, norm = sides[i]
            step = sum(m * left[b] for b, m in terms) / norm
            step = max(step, -x[i])
            if step:
                x[i] += step
                moved += abs(step)
                for b, m in terms:
                    left[b] -= m * step
        if moved <= 1e-3 * sum(x) + 1e-9:
            break
    return np.array(x)


def sequence_plan(histogram: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(times, bins) entries that use up the histogram; bins of an entry sum to the window at most."""
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[int, tuple[int, ...]]] = []

    def use(bins: tuple[int, ...], most: int) -> None:
        kinds, times = np.unique(bins, return_counts=True)
        times_each = min(most, int((left[kinds] // times).min()))
        if times_each > 0:
            left[kinds] -= times_each * times
            plan.append((times_each, bins))

    strategies = combinations_filling(window, np.flatnonzero(left))
    counts = np.rint(repeat_counts(left, strategies)).astype(np.int64)
    for i in np.argsort(-counts, kind="stable"):
        if counts[i] <= 0:
            break
        use(strategies[i], int(counts[i]))
    while left.any():  # greedy: the longest rest, then what fits best
        taken: list[int] = []
        gap, pool = window, left.copy()
        while gap > 0 and (fits := np.flatnonzero(pool[: gap + 1])).size:
            best = int(fits[-1])
            taken.append(best)
            pool[best] -= 1
            gap -= best
        use(tuple(taken), int(left.sum()))
    return plan


def plan_rows(plan: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(bin, rank_from, rank_to, per_sequence, first_sequence, first_slot) for each bin of each entry."""
    rows, used, sequence = [], {}, 0
    for times, bins in plan:
        kinds, per = np.unique(bins, return_counts=True)
        slot = 0
        for b, m in sorted(zip(kinds.tolist(), per.tolist(), strict=True), reverse=True):
            start = used.get(b, 0)
            rows.append((b, start, start + times * m, m, sequence, slot))
            used[b] = start + times * m
            slot += m
        sequence += times
    return rows


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, key: str) -> DataFrame:
    """Cut each document's ids, end id included, into whole windows and a rest.

    Columns: key, start, length, doc_tokens, ids (packed), ids_crc32, bin, part
    and seat (the piece's number among those of its bin in its part).
    """

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        one = encoder(tokenizer)
        kind, width = np.dtype(f"<u{one.width}"), one.width
        end = np.array([end_id], kind).tobytes()
        seats = [0] * (window // UNIT + 2)
        for batch in batches:
            names = ("start", "length", "doc_tokens", "ids", "ids_crc32", "bin", "seat")
            out: dict[str, list] = {n: [] for n in ("row", *names)}
            texts = ((i, text) for i, (text,) in enumerate(utf8_rows(batch, "text")))
            for row, ids in encoded_rows(texts, tokenizer):
                ids += end
                total = len(ids) // width
                for start in range(0, total, window):
                    own = ids[start * width : (start + window) * width]
                    length = len(own) // width
                    b = -(-length // UNIT)
                    crc = zlib.crc32(np.frombuffer(own, kind).astype("<u4").tobytes())
                    for n, v in zip(("row", *names), (row, start, length, total, own, crc, b, seats[b]), strict=True):
                        out[n].append(v)
                    seats[b] += 1
            keys = batch.column(batch.schema.get_field_index("key")).take(pa.array(out["row"], pa.int64()))
            arrays = [pa.array(out[n], pa.binary() if n == "ids" else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays(
                [keys, *arrays, pa.array([part] * len(keys), pa.int64())], names=["key", *names, "part"]
            )

    kind = docs.schema[key].dataType.simpleString()
    light = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    return light.mapInArrow(
        cut,
        f"key {kind}, start long, length long, doc_tokens long, ids binary, ids_crc32 long, bin long, seat long, part long",
    )


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, key: str = "doc_id") -> DataFrame:
    """Place every token of docs in sequences of at most window tokens.

    One row per piece: key, start, length, doc_tokens, ids (packed ids of the
    piece), ids_crc32, sequence_id and offset. A null or empty text is its end
    id alone; repeated keys are separate documents; an empty table gives no
    rows; other columns are ignored, whatever their names. A document longer
    than a window is cut at multiples of it, no other cuts are made. window is
    a multiple of UNIT.
    """
    if window % UNIT:
        raise ValueError(f"window must be a multiple of {UNIT}")
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, tokenizer, window, end_id, key), "pieces", "zstd")
    counts = pieces.groupBy("bin", "part").agg(F.count("*").alias("held"))
    counts = settle(counts, "piece-counts")
    histogram = np.zeros(window // UNIT + 1, np.int64)
    for row in counts.groupBy("bin").agg(F.sum("held").alias("n")).collect():  # window / UNIT rows at most
        histogram[row["bin"]] = row["n"]
    rows = plan_rows(sequence_plan(histogram))
    plan = spark.createDataFrame(
        rows, "bin long, rank_from long, rank_to long, per_sequence long, first_sequence long, first_slot long"
    )
    earlier = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bin", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["bin", "part"]).withColumn("rank", F.col("base") + F.col("seat"))
    # the plan's size depends on the window alone, so it may be broadcast
    placed = ranked.join(
        F.broadcast(plan),
        (ranked["bin"] == plan["bin"]) & (ranked["rank"] >= plan["rank_from"]) & (ranked["rank"] < plan["rank_to"]),
    ).drop(plan["bin"])
    at = F.col("rank") - F.col("rank_from")
    placed = placed.withColumns(
        {
            "sequence_id": F.col("first_sequence") + F.floor(at / F.col("per_sequence")).cast("long"),
            "slot": F.col("first_slot") + at % F.col("per_sequence"),
        }
    )
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("key").alias(key),
        "start",
        "length",
        "doc_tokens",
        "ids",
        "ids_crc32",
        "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
    )


def sequences(packed: DataFrame, window: int = 2048) -> DataFrame:
    """One row per sequence: its packed ids in order, how many, and the padding a window needs.

    A group holds a window of tokens at most.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("pieces")).select(
        "sequence_id",
        F.transform("pieces", lambda p: p["ids"]).alias("ids"),
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
    ).withColumn("padding", F.lit(window) - F.col("n_tokens"))
