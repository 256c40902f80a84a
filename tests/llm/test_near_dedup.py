"""Near-duplicate links that are easy to lose: dense regions, short texts, hot groups, odd keys."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from kinolith.llm import near_dedup

DATA = "/root/testdata/sf0.01"


def exact_components(sets: dict[int, frozenset]) -> dict[int, int]:
    """Components over all pairs with a common shingle."""
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order: dict = defaultdict(int)
    for s in sets.values():
        for x in s:
            order[x] += 1
    lists: dict = defaultdict(list)
    for i in sorted(sets):
        s = sets[i]
        whole = near_dedup.prefix_lengths(len(s))[1] if s else 0
        first = sorted(s, key=lambda x: (order[x], x))[:whole]
        for j in {j for x in first for j in lists[x]}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                one, two = root(i), root(j)
                parent[max(one, two)] = min(one, two)
        for x in first:
            lists[x].append(i)
    return {i: root(i) for i in sets}


def sets_of(rows) -> dict[int, frozenset]:
    return {i: frozenset(near_dedup.shingles((t or "").encode()).tolist()) for i, t in rows}


def components_of(df) -> dict[int, int]:
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def dense_region(texts: int, shared: int = 500, own: int = 99, pair: int = 25):
    """Texts of one template at about 0.70 of each other; those of i and i + texts / 2 are at 0.77."""
    template = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(texts):
        both = [f"p{i % (texts // 2)}x{j}" for j in range(pair)]
        rows.append((i, " ".join([*template, *both, *(f"o{i}x{j}" for j in range(own - pair))])))
    return rows


@pytest.mark.parametrize("texts", [400, 1600])
def test_dense_region(spark, texts):
    rows = dense_region(texts)
    some = sets_of([rows[0], rows[1], rows[texts // 2]])
    a, b, c = some.values()
    assert 0.69 < len(a & b) / len(a | b) < 0.75 <= len(a & c) / len(a | c) < 0.78
    found = components_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == {i: i % (texts // 2) for i in range(texts)}


def test_short_texts_at_the_threshold(spark):
    """Sets of 1 to 12 shingles with every overlap around three quarters."""
    rng = random.Random(8)
    rows, n = [], 0
    for size in range(1, 13):
        for more in range(0, 5):
            for _ in range(12):
                words = [f"r{rng.randrange(10**9)}" for _ in range(size + 4)]
                rows += [(n, " ".join(words)), (n + 1, " ".join([*words, *(f"z{rng.randrange(10**9)}" for _ in range(more))]))]
                n += 2
    want = exact_components(sets_of(rows))
    assert sum(i != c for i, c in want.items()) > 300
    assert components_of(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_marks_of_small_sets_spread_as_expected():
    """3 of 4 shingles in common: agreement is binomial around 896, so the bound loses none of 400 pairs."""
    rng = np.random.default_rng(4)
    same = []
    for _ in range(400):
        a = rng.integers(0, 2**64, 4, np.uint64)
        marks = [np.frombuffer(near_dedup.packed_marks(near_dedup.signature(x)), np.uint8)[None] for x in (a, a[:3])]
        same.append(int(near_dedup.agreeing(*marks)[0]))
    assert abs(np.mean(same) - 896) < 3 and np.std(same) < 14 and min(same) >= near_dedup.LEAST_AGREEING


def test_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = exact_components(sets_of([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert components_of(near_dedup.near_duplicates(docs)) == want


def test_hot_groups_and_odd_keys(spark):
    """Thousands of equal and of empty texts, one large group of near copies, null and repeated keys."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "same text in every row of this group") for i in range(10, 3010)]
    rows += [(i, None if i % 2 else " ") for i in range(4000, 6000)]
    rows += [(i, " ".join([*words, f"e{i}"])) for i in range(7000, 7600)]
    rows += [(None, "same text in every row of this group"), (None, "a text that only a row without a key has"), (None, None)]
    rows += [(7000, " ".join([*words, "e7000"]))]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    want = {**{i: 10 for i in range(10, 3010)}, **{i: i for i in range(4000, 6000)}, **{i: 7000 for i in range(7000, 7600)}}
    assert all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in found if r["doc_id"] is not None)
    assert sorted((r["component_id"] or -1, r["kept"]) for r in found if r["doc_id"] is None) == [(-1, True), (-1, True), (10, False)]
