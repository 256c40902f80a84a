"""Requests, job state, experiments, similarity joins and formats on small tables with known answers."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from kinolith.functions import text
from kinolith.operators import assembly, curate, features, metrics, requests, sampling, score, similarity, validate
from kinolith.sources import tables
from kinolith.streaming import jobs, quota


def collected(df):
    return {tuple(r) for r in df.collect()}


def test_running_totals_and_ranks_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") if rng.random() < 0.95 else None, rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id long")
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    total = dict(zip((r[2] for r in order), itertools.accumulate(r[1] for r in order)))
    assert {r["id"]: r["t"] for r in assembly.running_total(df, ["v", "id"], F.col("v"), "t").collect()} == total
    ranks: dict = {}
    sizes: dict = {}
    for g, _, _ in rows:
        sizes[g] = sizes.get(g, 0) + 1
    want = set()
    for g, v, i in order:
        want.add((g, v, i, ranks.get(g, 0), sizes[g]))
        ranks[g] = ranks.get(g, 0) + 1
    assert collected(assembly.rank_in_groups(df, ["g"], ["v", "id"], "r", "n")) == want
    assert assembly.dense_rank_over_ranges(df.limit(0), ["id"], "r").count() == 0


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(2)
    values = {g: rng.integers(0, 30, n).astype(float) for g, n in (("a", 1), ("b", 2), ("c", 301))}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("c", None), ("d", None)]
    found = assembly.quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"low": 0.1, "mid": 0.5})
    assert {r["g"]: (r["low"], r["mid"]) for r in found.collect()} == {g: (pytest.approx(np.quantile(x, 0.1)), pytest.approx(np.quantile(x, 0.5))) for g, x in values.items()}
    whole = assembly.quantiles(spark.createDataFrame(rows, "g string, x double"), [], "x", {"mid": 0.5}).first()["mid"]
    assert whole == np.median(np.concatenate(list(values.values())))


def test_contained_names(spark, monkeypatch):
    left = spark.createDataFrame([(1, "Homo sapiens strain"), (2, "xHOMOx"), (3, "none"), (4, None), (5, "ab")], "id int, t string")
    names = spark.createDataFrame([("sapiens", 2), ("homo", 1), ("ab", 0)], "part string, pos int")
    want = {(1, "homo"), (2, "homo"), (3, "*"), (4, "*"), (5, "ab")}
    assert collected(assembly.contained_in(left, names, "t", "part", "pos").select("id", "part")) == want
    monkeypatch.setattr(assembly, "MOST_PARTS", 1)
    assert collected(assembly.contained_in(left, names, "t", "part", "pos").select("id", "part")) == want


def test_override_guard(spark):
    rows = spark.createDataFrame([(1, "S", 5.0), (2, "T", None), (3, "U", None)], "id int, seq string, v double")
    facts = spark.createDataFrame([(1, "other", 0, 9.0), (1, "S", 1, 7.0), (2, "old", 0, 8.0)], "id int, seq string, position int, v double")
    found = assembly.override(rows, facts, ["id"], "v", guard="seq")
    assert collected(found) == {(1, "S", 7.0, "experiment"), (2, "T", None, None), (3, "U", None, None)}


TARGETS = (requests.Target("first", {"A": ("Substrates", "Products"), "B": ("Substrate",)}), requests.Target("second", {"B": ("Substrate",)}))


@pytest.mark.parametrize(
    "kind, one, two, handling, error, required",
    [
        ("first", "A", None, "skip", None, ["Seq", "Substrates", "Products"]),
        ("both", "B", "B", "truncate", None, ["Seq", "Substrate"]),
        ("second", "Z", "B", "skip", None, ["Seq", "Substrate"]),
        ("both", "B", None, "skip", "invalid second method", ["Seq", "Substrate"]),
        (None, "A", "B", "skip", "invalid prediction type", ["Seq"]),
        ("first", "B", None, "cut", "invalid handling of long sequences", ["Seq", "Substrate"]),
    ],
)
def test_request_parameters(spark, kind, one, two, handling, error, required):
    rows = spark.createDataFrame([(kind, one, two, handling)], "k string, a string, b string, h string")
    methods = {"first": F.col("a"), "second": F.col("b")}
    needed = requests.required_columns(F.col("k"), methods, TARGETS, ["Seq"])
    found = rows.select(requests.parameter_error(F.col("k"), methods, F.col("h"), TARGETS), needed, requests.lacking(needed, F.array(F.lit("Seq")))).first()
    assert (found[0], found[1], found[2]) == (error, required, ", ".join(required[1:]))


def test_short_ids_are_unique(spark):
    found = requests.short_ids(spark.range(200).union(spark.range(3)), "id", size=3).collect()
    assert len(found) == 200 and len({r["public_id"] for r in found}) == 200 and all(len(r["public_id"]) == 3 for r in found)
    with pytest.raises(ValueError):
        requests.short_ids(spark.range(20), "id", size=1, rounds=3)


def test_json_ready(spark):
    df = spark.createDataFrame([(1, float("nan"), [1.5, None], {"a": None}, None)], "i int, d double, l array<double>, m map<string,int>, s string")
    found = json.loads(requests.status_rows(df, df.columns).first()["status"])
    assert found == {"i": "1", "d": "NaN", "l": ["1.5", "NaN"], "m": {"a": "NaN"}, "s": "NaN"}


def test_refunds_and_read_or_refund(spark, tmp_path):
    rows = spark.createDataFrame([("j", "1", 2), ("j", None, 2), ("j", " ", 2), ("j", "", 2), ("k", "x", 9)], "job string, p string, asked int")
    assert collected(requests.refunds(rows, ["job"], "p", "asked")) == {("j", 1, 3, 2), ("k", 1, 0, 0)}
    assert jobs.read_or_refund(lambda: tables.read_csv(spark, str(tmp_path / "missing.csv")), "1.2.3.4", 7) == (None, ("1.2.3.4", 7))
    (tmp_path / "a.csv").write_text("x\n1\n")
    table, refund = jobs.read_or_refund(lambda: tables.read_csv(spark, str(tmp_path / "a.csv")), "1.2.3.4", 7)
    assert table.count() == 1 and refund is None


def test_flags_expire(spark):
    rng = random.Random(3)
    flags = [(rng.choice("ab"), rng.randint(0, 5000)) for _ in range(30)]
    probes = [(i, rng.choice("abc"), rng.randint(0, 6000)) for i in range(300)]
    at = F.timestamp_seconds("t")
    f = spark.createDataFrame(flags, "k string, t long").select("k", at.alias("t"))
    p = spark.createDataFrame(probes, "id int, k string, t long").select("id", "k", at.alias("t"))
    want = {i: any(k == g and 0 <= t - u <= 600 for g, u in flags) for i, k, t in probes}
    assert {r["id"]: r["flagged"] for r in jobs.flag_is_set(p, f, "k", "t", 600).collect()} == want


def test_flags_stream(spark, tmp_path):
    rows = [("a", 9000, "set"), ("a", 9500, "probe"), ("a", 9601, "probe"), ("b", 9005, "probe")]
    spark.createDataFrame(rows, "k string, t long, action string").select("k", F.timestamp_seconds("t").alias("ts"), "action").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.flags_stream(spark.readStream.schema("k string, ts timestamp, action string").parquet(str(tmp_path / "in")), "k")
    q = stream.writeStream.format("memory").queryName("flags_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["k"], r["s"], r["flagged"]) for r in spark.table("flags_out").select("k", F.unix_seconds("ts").alias("s"), "flagged").collect()} == {("a", 9500, True), ("a", 9601, False), ("b", 9005, False)}


def test_status_changes(spark):
    rows = [("j", "2024-01-01 10:00:00", 1, "Pending"), ("j", "2024-01-01 11:00:00", 2, "Processing"), ("j", "2024-01-03 00:00:00", 3, "Completed"), ("j", "2024-01-03 01:00:00", 4, "Processing"), ("k", "2024-01-01 00:00:00", 5, "Failed")]
    df = spark.createDataFrame(rows, "job string, t string, id int, status string").withColumn("t", F.to_timestamp("t"))
    found = {r["id"]: (r["before"], r["allowed"]) for r in jobs.status_changes(df, "job", "t", "status", "id").collect()}
    assert found == {1: (None, True), 2: ("Pending", True), 3: ("Processing", True), 4: ("Completed", False), 5: (None, False)}


def test_failure_classes(spark):
    rows = spark.createDataFrame([(137, None), (-9, None), (1, "killed by host"), (2, "x"), (0, None), (None, "OOM")], "c int, m string")
    found = [r[0] for r in rows.select(jobs.failure_class(F.col("c"), F.col("m"))).collect()]
    assert found == ["memory", "memory", "memory", "failed", None, "memory"]


def test_quota_fold_goes_on_over_batches(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["u", "v", None]), f"2024-01-0{rng.randint(1, 2)}", i, rng.choice([5, 9, -4, None])) for i in range(700)]
    df = spark.createDataFrame(rows, "u string, d string, id long, delta long").withColumn("ts", F.to_timestamp("d"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = {r["id"]: (r["accepted"], r["used"]) for r in quota.reserved(df, "u", "ts", "delta", 60, "id").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    used: dict = {}
    for u, d, i, x in rows:
        x, held = x or 0, used.get((u, d), 0)
        fits = x <= 0 or held + x <= 60
        used[u, d] = max(0, held + x) if fits else held
        assert found[i] == (fits, used[u, d])


def test_similar_pairs_are_exact(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LIST_BLOCK", 7)
    rng = random.Random(4)
    base = [[rng.randrange(40) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(i, " ".join(f"w{x}" for x in rng.choice(base) + [rng.randrange(40) for _ in range(rng.randint(0, 2))])) for i in range(250)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = {i: frozenset((t or "").split()) for i, t in rows}
    for least in (0.5, 0.8, 1.0):
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}
        found = similarity.expanded(df, "id", similarity.words_of(F.col("t")), least)
        assert {(r["a"], r["b"], r["shared"]) for r in found.collect()} == want and found.count() == len(want)
    train, test = df.where("id % 5 != 0"), df.where("id % 5 = 0")
    far = {i for i in sets if i % 5 and not any(j % 5 == 0 and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in sets)}
    assert {r["id"] for r in similarity.without_similar(train, test, "id", similarity.words_of(F.col("t")), 0.8).collect()} == far


def test_block_statistics(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 3)
    monkeypatch.setattr(similarity, "TARGET_BLOCK", 16)
    rng = np.random.default_rng(3)
    v = {i: rng.normal(size=5) for i in range(60)}
    odd = [(100, None), (105, [0.0] * 5), (110, []), (115, [float("nan")] * 5), (120, [None] * 5), (125, [float("inf")] * 5), (130, [1.0, 2.0]), (131, [2.0, 1.0]), (135, [1.0] * 3)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + odd, "id long, v array<double>")
    found = {r["query"]: (r["best"], r["mean"]) for r in similarity.block_statistics(df, "id", "v", 5).collect()}
    for q in range(0, 60, 5):
        scores = [round(max(0.0, 100 * v[q] @ y / np.sqrt((v[q] @ v[q]) * (y @ y))), 6) for i, y in v.items() if i != q]
        assert found[q] == (pytest.approx(max(scores)), pytest.approx(np.mean(scores)))
    # vectors without a direction take no part, those of another length meet each other
    assert set(found) == {*range(0, 60, 5), 130, 135} and found[130] == (pytest.approx(80.0), pytest.approx(80.0)) and found[135] == (None, None)


def test_bands(spark):
    words = [f"w{i}" for i in range(10)]
    rows = [(1, words), (2, words), (3, words[:6]), (4, ["x"]), (5, ["x", "y", "z"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "id long, t string")
    assert collected(similarity.banded(df, "id", similarity.words_of(F.col("t")), [0.9, 0.5, 0.3])) == {(1, 0.9), (2, 0.9), (3, 0.5), (4, 0.3), (5, 0.3)}
    assert collected(similarity.clusters(df, "id", similarity.words_of(F.col("t")), 0.5)) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}


def test_mixup(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i), 1.0], float(i)) for i in range(60)] + [(99, 77, [0.0, 0.0], 0.0)], "id long, g int, v array<double>, y double")
    found = sampling.mixed(rows, "id", [["g"]], "v", "y").collect()
    assert len(found) == 60
    for r in found:
        assert r["partner"] != r["id"] and r["partner"] % 3 == r["id"] % 3 and 0 <= r["share"] <= 1
        assert r["y"] == pytest.approx(r["id"] * r["share"] + r["partner"] * (1 - r["share"])) and r["v"][0] == pytest.approx(r["y"])
    shares = [r[0] for r in spark.range(4000).select(sampling.beta_pick(F.col("id"), 0.4)).collect()]
    assert abs(np.mean(shares) - 0.5) < 0.03 and abs(np.var(shares) - 0.25 / 1.8) < 0.012  # ab / ((a + b)^2 (a + b + 1))


def test_bands_are_filled_up(spark):
    rows = spark.range(130).withColumn("band", F.when(F.col("id") < 100, 0.9).when(F.col("id") < 125, 0.4).otherwise(0.0))
    after = sampling.oversampled_bands(rows, "band", ["id"], [0.4, 0.0], 0.9, 0.15)
    assert collected(sampling.band_counts(rows, after, "band")) == {(0.9, 100, 100), (0.4, 25, 25), (0.0, 5, 15)}


@pytest.mark.parametrize("r, n", [(0.5, 10), (0.1, 200), (-0.9, 5), (0.0, 30)])
def test_correlation_p(spark, r, n):
    t = abs(r) * math.sqrt((n - 2) / (1 - r * r))
    x = np.linspace(0, t, 200_001)
    density = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt((n - 2) * math.pi) * (1 + x * x / (n - 2)) ** (-(n - 1) / 2)
    found = metrics.correlation_p(spark.createDataFrame([(r, n)], "pearson double, n long")).first()["p"]
    assert found == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-7)


def test_correlation_p_without_rows(spark):
    found = metrics.correlation_p(spark.createDataFrame([(None, 2), (1.0, 2)], "pearson double, n long"))
    assert [r["p"] for r in found.collect()] == [None, None]


def test_confusion(spark):
    rows = spark.createDataFrame([([0, 1], [1, 2], 5)], "t array<int>, p array<int>, n int")
    r = metrics.confusion(rows, "t", "p", "n").first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 2) and r["f2"] == pytest.approx(0.5) and r["g_mean"] == pytest.approx(math.sqrt(0.5 * 2 / 3))


def test_robust_scaling_and_dictionaries(spark):
    rows = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "id long, v array<double>")
    found = {(r["id"], r["dim"]): r["z"] for r in features.robust_scaled(rows, "id", "v").collect()}
    assert found[4, 0] == 1.0 and found[2, 0] == 0.0 and found[3, 1] == 0.0
    words = spark.createDataFrame([(0, "b a"), (1, "a c")], "p long, t string")
    assert collected(features.growing_dictionary(words, "p", F.split("t", " ")).select("token", "id")) == {("b", 0), ("a", 1), ("c", 2)}


def test_reduced_reuses_what_was_fitted(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, (rng.normal() * np.ones(4) + rng.normal(size=4) * 0.01).tolist()) for i in range(40)], "id long, v array<double>")
    found, fitted = features.reduced(rows, "id", "v", 2)
    again, same = features.reduced(rows.limit(3), "id", "v", 2, fitted)
    values = {r["id"]: r["v"] for r in found.collect()}
    assert same is fitted and all(r["v"] == pytest.approx(values[r["id"]]) for r in again.collect())
    assert np.var([v[0] for v in values.values()]) > 100 * np.var([v[1] for v in values.values()])


def test_blocks_and_stacks(spark):
    with pytest.raises(ValueError):
        features.in_canonical_order({"x": F.array(F.lit(1))}, ["a"])
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 0, 0.1), (1, 1, 0.3)], "id int, tree int, v double")
    assert features.stacked(rows, "id", "tree", "v").first()["trees"] == [0.1, 0.3, 0.5]


def test_emptiness_as_specified(spark):
    """Blank shares: all, 30 % of 10, 20 % of 5, 11.1 % of 9, 10 % of 10, 5 % of 20."""
    for n, blanks, verdict, listed in ((4, 4, "empty", "0,1,2,3"), (10, 3, "gaps", "0,1,2"), (5, 1, "gaps", "0"), (9, 1, "gaps", "0"), (10, 1, "ok", "0"), (20, 1, "ok", "0"), (30, 12, "gaps", "")):
        rows = spark.createDataFrame([(i, None if i < blanks and i % 2 else " " if i < blanks else "x") for i in range(n)], "row long, a string")
        r = validate.column_emptiness(rows, ["a"], "row").first()
        assert (r["n"], r["blanks"], r["verdict"], r["row_list"]) == (n, blanks, verdict, listed)


def test_training_filters(spark):
    rows = spark.createDataFrame([("A" * 1499, 1.0, "CC"), ("A" * 1500, 1.0, "CC"), ("A", 0.0, "CC"), ("A", 1.0, "C.C")], "s string, v double, m string")
    assert curate.trainable(rows, "s", "v", "m").count() == 1
    paths = spark.createDataFrame([("k", 1.0, "b"), ("k", 3.0, "a"), ("k", 2.0, "b")], "k string, v double, p string")
    assert collected(curate.maxima_with_paths(paths, ["k"], "v", "p")) == {("k", 3.0, "a;b")}


@pytest.mark.parametrize(
    "line, want",
    [
        ("/opt/conda/bin/conda run", "[CONDA] run"),
        ("x /tmp/tmpab_1/queryDB_h y", "x [TMP_QUERY_DB] y"),
        ("/tmp/tmpq.fasta", "[TMP_DIR].fasta"),
        ("open /dbs/t_one and t_one", "open TARGET_DB(one) and TARGET_DB(one)"),
        ("/home/me/a/b", "[HOME][PATH]"),
        ("see queryDB pref_3 /etc/x", "see [QUERY_DB] [PREF_DB] [PATH]"),
        ("/srv/app/media/f", "[MEDIA][PATH]"),
    ],
)
def test_log_lines(spark, line, want):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(text.redacted_line(F.col("l"), {"one": "/dbs/t_one"}, {"/srv/app": "[APP]", "/srv/app/media": "[MEDIA]"})).first()[0] == want


def test_text_forms(spark):
    df = spark.createDataFrame([("C00001",), ("InChI=1S/H2O",), ("CC(=O)O",), ("CC(=O",), ("a b",), ("",)], "m string")
    assert [r[0] for r in df.select(text.metabolite_type(F.col("m"))).collect()] == ["KEGG", "InChI", "SMILES", "invalid", "invalid", "invalid"]
    one = spark.range(1)
    assert one.select(text.joined_key(F.lit("a&b"), F.lit("c"))).first()[0] != one.select(text.joined_key(F.lit("a"), F.lit("b&c"))).first()[0]
    assert one.select(text.nested_parts(F.lit("1,2|3"))).first()[0] == ["1", "2", "3"]
    codes = text.letter_codes(F.lit("cab"), "abc", 5)
    assert one.select(codes, text.from_letter_codes(codes, "abc")).first()[0:2] == ([0, 0, 3, 1, 2], "cab")
    assert one.select(text.reaction(F.array(F.lit("CC"), F.lit("O")), F.array(F.lit("CCO")))).first()[0] == "CC.O>>CCO"


def test_formats(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one > two\r\nACD\r\nEF\n>b\nGH\n")
    assert collected(tables.read_fasta(spark, str(tmp_path / "x.fa"))) == {("a", "ACDEF"), ("b", "GH")}
    (tmp_path / "c.tsv").write_text("1\t1\n1\t2\n3\t3\n")
    assert collected(tables.read_clusters(spark, str(tmp_path / "c.tsv"))) == {(1, 1, 2), (1, 2, 2), (3, 3, 1)}
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    tables.write_json_array(rows, str(tmp_path / "array"))
    tables.write_json_array(rows.limit(0), str(tmp_path / "none"))
    read = lambda d: json.loads("".join(f.read_text() for f in sorted((tmp_path / d).glob("part-*"))))
    assert read("array") == [{"id": 1, "t": "a"}, {"id": 2}] and read("none") == []
    paths = tables.write_all(rows, str(tmp_path / "all"))
    assert spark.read.json(paths["json"]).count() == spark.read.option("header", True).csv(paths["csv"]).count() == 2
    cache = str(tmp_path / "cache")
    for _ in range(2):  # two writers that did not see each other
        rows.write.mode("append").parquet(cache)
    assert tables.read_cache(spark, cache, ["id"]).count() == 2


def test_named_things():
    held = score.Named("vectoriser")
    held.add("a", 1)
    assert held.get("a") == 1
    with pytest.raises(KeyError):
        held.get("b")
    with pytest.raises(ValueError):
        held.add("a", 2)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=25))
def test_walk_never_leaves_its_budget(deltas):
    accepted, after, used = quota.walk([d - 2 for d in deltas], 6)
    assert all(0 <= u <= 6 for u in after) and used == after[-1] and len(accepted) == len(deltas)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_quantiles_by_counts_and_by_ranges(spark, monkeypatch, few):
    """Both ways give numpy's quantiles, with null groups and null values."""
    monkeypatch.setattr(assembly, "FEW_VALUES", few)
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, v int")
    found = {r["g"]: (r["low"], r["mid"], r["n"]) for r in assembly.quantiles(df, ["g"], "v", {"low": 0.1, "mid": 0.5}, "n").collect()}
    for g in ("a", "b", None):
        own = [v for h, v in rows if h == g and v is not None]
        assert found[g] == (pytest.approx(np.quantile(own, 0.1)), pytest.approx(np.quantile(own, 0.5)), len(own))
    whole = assembly.quantiles(df, [], "v", {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))


def test_tables_that_cannot_be_read_are_refunded(spark, tmp_path):
    from kinolith.streaming import jobs

    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("a,b\n1,2\n3,4\n")
    bad.write_text("a,b\n1,2\nx,4\n")
    read = lambda path: lambda: spark.read.option("mode", "FAILFAST").option("header", True).schema("a int, b int").csv(str(path))
    table, refund = jobs.read_or_refund(read(good), "1.2.3.4", 2)
    assert table.count() == 2 and refund is None
    assert jobs.read_or_refund(read(bad), "1.2.3.4", 2) == (None, ("1.2.3.4", 2))  # the line is not the first
    assert jobs.read_or_refund(read(tmp_path / "none.csv"), "1.2.3.4", 2) == (None, ("1.2.3.4", 2))
    with pytest.raises(ZeroDivisionError):
        jobs.read_or_refund(lambda: 1 / 0, "1.2.3.4", 2)


def test_memory_words_count_anywhere(spark):
    from kinolith.streaming import jobs

    rows = [(1, 1, "invalid parameter"), (2, -9, None), (3, 1, "bad value"), (4, 0, None), (5, 137, "x"), (6, 1, "Out of Memory")]
    df = spark.createDataFrame(rows, "id int, code int, message string")
    found = {r["id"]: r["c"] for r in df.select("id", jobs.failure_class(F.col("code"), F.col("message")).alias("c")).collect()}
    assert found == {1: "memory", 2: "memory", 3: "failed", 4: None, 5: "memory", 6: "memory"}


@pytest.mark.parametrize("sent", [0, 10_000])
def test_hot_keys_are_joined_apart(spark, monkeypatch, sent):
    """A key with most rows, null keys and rare ones: the same rows as a plain join, and no task with all of the hot key."""
    from kinolith.operators import staging
    from kinolith.operators.staging import join_facts

    monkeypatch.setattr(staging, "SENT_ROWS", sent)

    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit(-1)).when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 400).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("size"), F.max("id").alias("top"))
    found = join_facts(rows.repartition(8), facts, ["k"], "size")
    assert found.columns == ["k", "id", "top"] and found.count() == 20_000
    want = {r["k"]: r["top"] for r in facts.collect()}
    assert all(want[r["k"]] == r["top"] for r in found.collect())
    most = found.where("k = -1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 4_000
    none = join_facts(rows, facts.where("k = 7"), ["k"], "size", "inner")
    assert {r["k"] for r in none.collect()} <= {7}


def test_components_of_a_star_and_a_chain(spark):
    """A node with most edges, and labels that nearly all nodes come to have."""
    star = [(0, i) for i in range(1, 3000)]
    chain = [(i, i + 1) for i in range(5000, 5040)]
    edges = spark.createDataFrame(star + chain, "a long, b long")
    nodes = spark.range(5100).where("id < 3000 or id >= 5000")
    found = {r["id"]: r["label"] for r in similarity.connected(edges, nodes).collect()}
    assert found == {i: 0 if i < 3000 else 5000 if i <= 5040 else i for i in (*range(3000), *range(5000, 5100))}


def test_no_task_gets_a_frequent_token(spark, monkeypatch):
    """A token that all sets have: its list meets in blocks, each two of which are a key of their own."""
    monkeypatch.setattr(similarity, "LIST_BLOCK", 50)
    rows = spark.range(400).select("id", F.array(F.lit("all"), F.concat(F.lit("t"), F.col("id").cast("string"))).alias("s"))
    seen = []
    joined = DataFrame.join

    def spy(self, other, on=None, how=None):
        if isinstance(on, list) and len(on) == 3 and how is None:
            sizes = lambda side, name: side.groupBy(f"{name}.token", f"{name}.xb", f"{name}.yb").count().agg(F.max("count")).first()[0]
            seen.append((sizes(self, "x"), sizes(other, "y")))
        return joined(self, other, on, how)

    monkeypatch.setattr(DataFrame, "join", spy)
    assert similarity.similar_pairs(rows, "id", F.col("s"), 0.3).count() == 400 * 399 // 2
    assert seen and max(max(s) for s in seen) < 100
