"""Stores, studies, sessions, balanced folds, densities and batch inference."""

from __future__ import annotations

import itertools
import math
import random
import threading
import time
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinolith.operators import metrics, registry, sampling, score, study
from kinolith.sources.store import Store, missing_batches, usage_batches
from kinolith.streaming import sessions


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_store_keeps_one_row_a_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "k long, v string")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (None, "x")], "k long, v string")
    assert store.read().count() == 0
    assert store.add_missing(first, ["k"], "w1-0") and not store.add_missing(first, ["k"], "w1-0")  # a repeated batch
    assert rows_of(store.read()) == [(1, "a"), (2, "a")]
    assert store.add_missing(spark.createDataFrame([(2, "z"), (3, "c")], "k long, v string"), ["k"], "w2-0")
    assert rows_of(store.read()) == [(1, "a"), (2, "a"), (3, "c")] and rows_of(store.read(upto=0)) == [(1, "a"), (2, "a")]
    assert [c["batch"] for c in store.commits()] == ["w1-0", "w2-0"]


def test_a_writer_that_comes_second_looks_again(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", "k long, v string")
    other = Store(spark, store.path, store.schema)
    asked = []

    def slow(have):
        asked.append(have.count())
        if len(asked) == 1:  # another writer commits in between
            other.add_missing(spark.createDataFrame([(1, "other")], "k long, v string"), ["k"], "b-0")
        return spark.createDataFrame([(1, "mine"), (2, "mine")], "k long, v string").join(have.select("k"), "k", "left_anti")

    assert store.commit("a-0", slow) and asked == [0, 1]
    assert rows_of(store.read()) == [(1, "other"), (2, "mine")]


def test_two_writers_at_a_time(spark, tmp_path):
    path = f"file://{tmp_path}/s"

    def write(name):
        store = Store(spark, path, "k long, v string")
        for i in range(3):
            store.add_missing(spark.createDataFrame([(k, name) for k in range(i, i + 4)], "k long, v string"), ["k"], f"{name}-{i}")

    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = Store(spark, path, "k long, v string")
    assert sorted(r["k"] for r in store.read().collect()) == list(range(6)) and len(store.commits()) == 6


def test_streams_into_stores(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text("x,2024-01-01 00:00:01\ny,2024-01-01 00:00:02\nx,2024-01-01 00:00:03\n")
    cache = Store(spark, f"file://{tmp_path}/cache", "seq string, at timestamp")
    usage = Store(spark, f"file://{tmp_path}/usage", registry.USAGE)

    def run():
        stream = spark.readStream.schema("seq string, at timestamp").csv(str(source))
        for name, work in (("c", missing_batches(cache, ["seq"], "one")), ("u", usage_batches(usage, "seq", "at", "one"))):
            stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination(120)

    run()
    (source / "b.csv").write_text("x,2024-01-02 00:00:01\nz,2024-01-02 00:00:02\n ,2024-01-02 00:00:02\n")
    run()
    again = spark.createDataFrame([("x", datetime(2024, 1, 2, 0, 0, 1)), ("z", datetime(2024, 1, 2, 0, 0, 2))], "seq string, at timestamp")
    usage_batches(usage, "seq", "at", "one")(again, 1)  # a batch that is repeated after its commit
    assert sorted(r["seq"] for r in cache.read().collect()) == [" ", "x", "y", "z"]
    found = {r["seq"]: (r["uses_count"], r["len"]) for r in registry.from_usage(usage.read()).collect()}
    assert found == {"x": (3, 1), "y": (1, 1), "z": (1, 1)}


def test_study_goes_on(spark, tmp_path):
    space = {"x": study.Between(-4, 4), "rate": study.Between(1e-4, 1, log=True), "kind": ["a", "b", "c"]}
    done = []

    def objective(p):
        done.append(p)
        if len(done) == 3:
            raise ValueError("bad luck")
        return -((p["x"] - 1) ** 2) - (math.log10(p["rate"]) + 2) ** 2 - (p["kind"] != "b")

    path = f"file://{tmp_path}/log"
    study.run(spark, path, space, objective, 18, most=5)
    assert len(done) == 5
    log = [r.asDict() for r in study.run(spark, path, space, objective, 18).orderBy("trial").collect()]
    assert [t["trial"] for t in log] == list(range(18)) and len(done) == 18  # none twice
    assert [study.proposed(space, log, i, 42) for i in range(18)] == done  # what a trial gets follows from those before it
    assert log[2]["value"] is None and "bad luck" in log[2]["error"]
    assert study.run(spark, path, space, objective, 18).count() == 18 and len(done) == 18
    assert study.best(log)["value"] == max(t["value"] for t in log if t["value"] is not None)
    late = [t["value"] for t in log[study.FIRST :]]
    assert np.median(late) > np.median([t["value"] for t in log[: study.FIRST] if t["value"] is not None])


def test_session_feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.STORE)
    source, out = tmp_path / "in", f"{tmp_path}/out"
    source.mkdir()

    def start():
        lines = spark.readStream.schema("session string, seq long, line string").csv(str(source))
        feed = sessions.session_feed(lines, seconds=1.0)
        return feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()

    def read():
        try:
            rows = spark.read.parquet(out).collect()
        except Exception:  # noqa: BLE001  nothing is written yet
            return []
        return [(r["session"], r["number"], r["kind"], r["line"]) for r in rows]

    def wait(test):
        end = time.time() + 90
        while not test(read()):
            assert time.time() < end, read()
            time.sleep(1)

    (source / "a.csv").write_text("s,2,two\ns,1,one\nt,1,only\nt,2,__FINISHED__\n")
    query = start()
    wait(lambda rows: ("s", 2, "keep-alive", None) in rows)
    query.stop()
    (source / "b.csv").write_text("s,3,three\ns,4,__FINISHED__\ns,5,late one\nt,3,later\n")
    query = start()
    wait(lambda rows: ("s", 3, "end", None) in rows and ("t", 1, "late", "later") in rows)
    time.sleep(3)
    query.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = [r for r in read() if r[2] != "keep-alive"]
    ended = [("s", 0, "open", None), ("s", 1, "line", "one"), ("s", 2, "line", "two"), ("s", 3, "line", "three"), ("s", 3, "end", None), ("s", 3, "late", "late one")]
    assert Counter(r for r in rows if r[0] == "s") == Counter(ended)
    assert Counter(r for r in rows if r[0] == "t") == Counter([("t", 0, "open", None), ("t", 1, "line", "only"), ("t", 1, "end", None), ("t", 1, "late", "later")])
    assert all(r[0] == "s" and r[1] == 2 for r in read() if r[2] == "keep-alive")  # none after an end


def greedy(sizes, k):
    load, fold = [0] * k, {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        fold[name] = f
        load[f] += n
    return fold, load


def test_fold_plan_is_greedy():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randint(1, 6)
        sizes = {i: rng.choice([1, 1, 2, 3, 7, 20, 90]) for i in range(rng.randint(1, 60))}
        plan = sampling.fold_plan(list(Counter(sizes.values()).items()), k)
        want, _ = greedy(sizes, k)
        seen = Counter()
        for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
            start, turns = [p for p in plan[n] if p[0] <= seen[n]][-1]
            assert want[name] == turns[(seen[n] - start) % len(turns)]
            seen[n] += 1
    big = sampling.fold_plan([(10**9, 1), (1, 4 * 10**9 + 3)], 5)  # a hot group beside very many small ones
    assert len(big[1]) <= 5


def test_balanced_folds(spark):
    rng = random.Random(4)
    rows = [(g, i) for g in range(40) for i in range(rng.choice([1, 2, 2, 9]))] + [(99, i) for i in range(80)] + [(None, 1), (None, 2)]
    found = sampling.balanced_folds(spark.createDataFrame(rows, "g long, i long"), "g", 4)
    got = {(r["g"], r["fold"]) for r in found.collect()}
    want, load = greedy({-1 if g is None else g: n for g, n in Counter(g for g, _ in rows).items()}, 4)
    assert got == {(None if g == -1 else g, f) for g, f in want.items()} and found.count() == len(rows)


def test_kernel_density(spark):
    rng = np.random.default_rng(2)
    points = np.column_stack([rng.integers(0, 30, 200), rng.integers(0, 20, 200)])
    counts = Counter(map(tuple, points.tolist()))
    cells = spark.createDataFrame([(int(a), int(b), n) for (a, b), n in counts.items()], "x int, y int, n long")
    found = {(r["x"], r["y"]): r["density"] for r in metrics.kernel_density(cells, "x", "y", "n", 2.5, 1.5).collect()}
    top = 1 / (2 * math.pi * 2.5 * 1.5)
    for (a, b), d in itertools.islice(found.items(), 200):
        direct = sum(math.exp(-0.5 * (((a - p) / 2.5) ** 2 + ((b - q) / 1.5) ** 2)) for p, q in points) * top
        assert abs(d - direct) <= 200 * 0.0004 * top + 1e-12
    assert abs(sum(found.values()) - 200) < 0.5


def test_batches_of_a_model(spark):
    rows = spark.createDataFrame([(i, float(i), None if i % 7 == 0 else 2.0) for i in range(1000)], "i long, a double, b double")

    def load():
        def model(a, b):
            assert len(a) <= 64
            return 3 * a + b

        return model

    found = {r["i"]: r["prediction"] for r in score.predicted(rows.repartition(2), ["a", "b"], load, batch=64).collect()}
    assert found == {i: None if i % 7 == 0 else 3.0 * i + 2 for i in range(1000)}
