"""Operators on small tables with known answers."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinolith.functions import arrays, maths, text
from kinolith.operators import assembly, curate, features, registry, sampling, score, similarity, validate
from kinolith.sources import tables
from kinolith.streaming import quota


def one(spark, expression, **columns):
    rows = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<double>' if isinstance(v, list) else 'double'}" for k, v in columns.items()))
    return rows.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "expression, value, expected",
    [
        (lambda: text.head_tail(F.col("s"), 4), "abcdefgh", "abgh"),
        (lambda: text.head_tail(F.col("s"), 5), "abcdefgh", "abgh"),
        (lambda: text.head_tail(F.col("s"), 1), "abc", "a"),
        (lambda: text.head_tail(F.col("s"), 8), "abcdefgh", "abcdefgh"),
        (lambda: F.array_join(text.offending(F.col("s")), ""), "ACBZB1", "1BZ"),
        (lambda: F.size(text.offending(F.col("s"))), "ACDE", 0),
        (lambda: text.rare_residues_to_x(F.col("s")), "AUZC", "AXXC"),
        (lambda: text.joined_codes(F.col("s")), "mutant A12G and R34K", "A12G/R34K"),
        (lambda: text.apply_mutations(F.col("s"), F.array(F.lit("A1W"), F.lit("D3K"))), "ACDE", "WCKE"),
        (lambda: text.apply_mutations(F.col("s"), F.array(F.lit("C1W"))), "ACDE", None),
        (lambda: F.array_join(text.inferred_mutations(F.col("s"), F.lit("WCKE")), "/"), "ACDE", "A1W/D3K"),
        (lambda: F.array_join(text.ngrams(F.col("s"), 3), " "), "ABC", "-AB ABC BC="),
        (lambda: F.array_join(text.smiles_tokens(F.col("s")), " "), "CClBr%12N+2", "C Cl Br %12 N +2"),
        (lambda: text.first_address(F.col("s")), " 1.2.3.4 , 5.6.7.8", "1.2.3.4"),
        (lambda: text.nullish(F.col("s")), " None ", True),
        (lambda: F.array_join(arrays.split_list(F.col("s")), "|"), "a; b;;c ", "a|b|c"),
        (lambda: text.redacted_line(F.col("s")), "see /usr/lib/x.py now", "see [PATH] now"),
    ],
)
def test_text(spark, expression, value, expected):
    assert one(spark, expression(), s=value) == expected


def test_arrays_and_numbers(spark):
    assert one(spark, arrays.quantile(F.col("a"), 0.25), a=[4.0, 1.0, 3.0, 2.0]) == pytest.approx(1.75)
    assert one(spark, arrays.deviation(F.col("a")), a=[1.0, 3.0]) == 1.0
    assert sum(one(spark, arrays.softmax(F.col("a")), a=[1.0, 2.0, 3.0])) == pytest.approx(1)
    assert [one(spark, maths.percent_bin(F.col("x")), x=v) for v in (0.5, 1.5, 2.5, 100.4, -3.0)] == [0, 2, 2, 100, 0]
    assert one(spark, maths.winkler(F.col("x"), F.lit(1.0), F.lit(2.0), 0.1), x=3.0) == 21.0
    assert one(spark, maths.rank_sum_p(F.col("x")), x=1.959964) == pytest.approx(0.05, abs=1e-6)
    assert maths.kernel("triangular", 3)[1] == 1 and max(maths.kernel("gaussian")) == 1


def test_registry(spark):
    batch = ["AAA", "BBB", "AAA", " ", "CCC", "BBB", "AAA", None]
    rows = spark.createDataFrame(list(enumerate(batch)), "pos long, seq string")
    found = registry.register(rows, "seq", "pos")
    assert {r["seq"]: r["uses_count"] for r in found.collect()} == {"AAA": 3, "BBB": 2, "CCC": 1}
    again = registry.merged(found, found)
    assert again.agg(F.sum("uses_count")).first()[0] == 12 and again.count() == 3
    assert registry.mismatches(found).first()["mismatches"] == 0


def test_emptiness(spark):
    rows = spark.createDataFrame([(i, None if i < 2 else "x", " ") for i in range(10)], "row long, a string, b string")
    found = {r["column"]: r for r in validate.column_emptiness(rows, ["a", "b"], "row").collect()}
    assert found["a"]["verdict"] == "gaps" and found["a"]["row_list"] == "0,1"
    assert found["b"]["verdict"] == "empty" and found["b"]["blanks"] == 10
    assert validate.layout(["Protein Sequence", "Substrates", "Products"]) == "multi" and validate.layout(["x"]) == "invalid"
    assert validate.effective_limit("D") == 10_000 and validate.effective_limit("C") == 1000


def test_assembly(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, None)], "k long, p long, v string")
    assert {tuple(r) for r in assembly.first_per_key(rows, ["k"], ["p"]).collect()} == {(1, 1, "a"), (2, 5, None)}
    assert {tuple(r) for r in assembly.last_per_key(rows, ["k"], "p").collect()} == {(1, 2, "b"), (2, 5, None)}
    facts = spark.createDataFrame([("x y", "o"), ("x z", "o"), ("", "o")], "ids string, o string")
    by_id = spark.createDataFrame([("x", "S"), ("y", "S"), ("z", "T")], "id string, sequence string")
    by_pair = spark.createDataFrame([("o", "P")], "o string, sequence string")
    found = {r["ids"]: r["sequence"] for r in assembly.attach_sequence(facts, by_id, by_pair, "ids", ["o"]).collect()}
    assert found == {"x y": "S", "x z": "P", "": "P"}
    ids = assembly.first_seen_ids(spark.createDataFrame([(i, v) for i, v in enumerate("banana")], "p long, v string"), "v", "p")
    assert {r["v"]: r["id"] for r in ids.collect()} == {"b": 0, "a": 1, "n": 2}
    assert assembly.preferred_order(rows, ["v", "zz"]).columns == ["v", "k", "p"]


def test_curate(spark):
    rows = spark.createDataFrame([("A12G/R34K", 1.0), ("R34K/A12G", 3.0), ("wildtype", 2.0)], "t string, v double")
    assert {tuple(r) for r in curate.max_per_set_key(rows, "t", "v").select("t", "v").collect()} == {("A12G/R34K", 3.0), ("wildtype", 2.0)}
    comments = spark.createDataFrame([("mutant A1G",), ("mutant",), ("A1G",)], "c string")
    assert [r["codes"] for r in curate.with_codes(comments, "c").collect()] == ["A1G"]


def test_components(spark, tmp_path):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (3, 7)], "a long, b long")
    found = {r["id"]: r["label"] for r in similarity.connected(edges, nodes, folder=str(tmp_path)).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 1, 7: 1, 4: 4, 5: 5, 6: 5}


def test_graph_labels(spark):
    nodes = spark.createDataFrame([(m, i, "C" if i else "O") for m in (1, 2) for i in range(3)], "mol long, i long, label string")
    both = [(1, 0, 1), (1, 1, 2), (2, 0, 2), (2, 2, 1)]  # the same path, numbered otherwise
    edges = spark.createDataFrame([(m, a, b, 1) for m, a, b in both] + [(m, b, a, 1) for m, a, b in both], "mol long, i long, j long, bond int")
    found = features.graph_labels(nodes, edges, 2).groupBy("mol").agg(F.array_sort(F.collect_list("label")).alias("l")).collect()
    assert found[0]["l"] == found[1]["l"]


def test_sampling(spark):
    rows = spark.range(1000).withColumn("bin", (F.col("id") < 50).cast("int"))
    copies = sampling.oversampled(rows, "bin", ["id"])
    assert {r["bin"]: r["count"] for r in copies.groupBy("bin").count().collect()} == {0: 1000, 1: 1000}  # twice the median of 950 and 50
    assert copies.select("id", "copy").distinct().count() == 2000 and copies.select("id").distinct().count() == 1000
    assert sampling.exact_split(rows, "id").where("train").count() == 800
    assert sampling.repeated_samples(rows, "id", 0.9, 3).groupBy("repeat").count().count() == 3


def test_scorer_runs_on_misses_only(spark):
    seen = score.Scorer("length", ("s",), lambda: None, lambda m, f: pd.Series([float("nan") if x == "cached" else float(len(x)) for x in f["s"]]))
    rows = spark.createDataFrame([("a",), ("bb",), ("bb",), ("cached",)], "s string")
    cache = spark.createDataFrame([("cached", 9.0)], "s string, prediction double")
    assert sorted(r["prediction"] for r in score.scored(rows, seen, cache).collect()) == [1.0, 2.0, 2.0, 9.0]
    reg = score.Registry()
    reg.add(seen)
    with pytest.raises(KeyError):
        reg.get("other")


def test_quota_rules(spark):
    assert quota.walk([60, 40, 1, -30, 20], 100) == ([True, True, False, True, True], [60, 100, 100, 70, 90], 90)
    assert quota.walk([-5, 100, 1], 100) == ([True, True, False], [0, 100, 100], 100)
    lines = spark.createDataFrame([("done 3/4",), ("x",), ("9/4",), ("1/0",)], "line string")
    assert [r["percent"] for r in quota.progress(lines, "line").collect()] == [75, 100, 0]


def test_quota_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", 60), ("a", "2024-01-01 01:00:00", 50), ("b", "2024-01-01 02:00:00", 10)], "ip string, t string, delta long")
    rows.select("ip", F.to_timestamp("t").alias("ts"), "delta").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("ip string, ts timestamp, delta long").parquet(str(source))
    out = quota.reserved_stream(stream, "ip", "delta", 100)
    q = out.writeStream.format("memory").queryName("quota_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["ip"], r["accepted"], r["used"]) for r in spark.table("quota_out").collect()) == [("a", False, 60), ("a", True, 60), ("b", True, 10)]


def test_sources(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACD\nEF\n>b\nGH\n")
    assert {tuple(r) for r in tables.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {("a", "ACDEF"), ("b", "GH")}
    (tmp_path / "hits.tsv").write_text("q\tt\t50.5\nq\tt\nq\tu\tx\n")
    assert [r["pident"] for r in tables.read_hits(spark, str(tmp_path / "hits.tsv")).collect()] == [50.5]
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    assert {tuple(r) for r in tables.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "1"), ("b", "2")}
    (tmp_path / "in.csv").write_text("p,q\n a ,1\n,2\n,\n")
    assert tables.read_csv(spark, str(tmp_path / "in.csv")).count() == 2
    assert [r["p"] for r in tables.read_named(spark, str(tmp_path / "in.csv"), ["p"]).collect()] == ["a"]
    lines = spark.createDataFrame([("ec*1.1#org*x",), ("org*y",)], "line string")
    assert [tuple(r) for r in tables.tagged_records(lines, "line", ["ec", "org"]).collect()] == [("1.1", "x"), ("*", "y")]
    cache = str(tmp_path / "cache")
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    tables.append_missing(batch, cache, ["id"])
    assert tables.append_missing(batch, cache, ["id"]).count() == 2
    (tmp_path / "p.txt").write_text("ID  one\nXX two\nID  three\n")
    assert [r["value"] for r in tables.read_prefixed(spark, str(tmp_path / "p.txt"), "ID").collect()] == ["one", "three"]
