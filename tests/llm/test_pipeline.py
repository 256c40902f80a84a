"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import re

import public_tokenizers

import corpus_pipeline
from kinolith.llm import pii
from kinolith.llm.shared import settle

DATA = "/root/testdata/sf0.001"


def components(texts: dict[int, str]) -> dict[int, int]:
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in sets}


def test_stages(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = source.columns
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 !", "en", "s", 4)], source.schema)
    docs = source.union(extra)
    want = {r["doc_id"]: r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["language_id"](spark, docs, DATA)
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want
    want = {i: want[i] for i, root in components(want).items() if i == root}
    docs = stages["near_dedup"](spark, docs, DATA).cache()
    assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want
    model = pii.trained()
    for i, text in want.items():
        base = pii.base_spans(text)
        want[i] = pii.redacted(text, base + pii.model_spans(text, model, base))
    docs = stages["pii"](spark, docs, DATA)
    have = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert docs.columns == columns and have == {i: (t, len(t)) for i, t in want.items()}
    assert not any("@mail" in t for t in want.values())
    pieces = stages["packing"](spark, docs, DATA).collect()
    tokens = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    held: dict[int, int] = {}
    for p in pieces:
        held[p["doc_id"]] = held.get(p["doc_id"], 0) + p["length"]
    assert held == tokens


def test_run_gives_the_last_stages_rows(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_odd_columns_and_rows(spark):
    """Columns that stages use inside keep their values; no n_chars; null, repeated and unexplained rows; an empty table."""
    fields = "doc_id long, text string, lang string, score double, lang_pred string, Excess int, key string, id long, n long, kept boolean"
    known = [(r["doc_id"] + 100, r["text"], r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    odd = [(1, "a text that comes twice with one id", "en"), (1, "a text that comes twice with one id", "en"), (2, "a text that comes twice with one id", "en"), (None, "no id, mail a@b.cd", "en"), (None, "no id, mail a@b.cd", None), (3, None, None), (4, "", "en"), (5, "12 34", "en"), (6, "漢字假名交じり文章" * 30, None)]
    rows = [(*r, 0.25 + i, f"p{i}", i, f"k{i}", 7, 8, False) for i, r in enumerate(known + odd)]
    docs = spark.createDataFrame(rows, fields)
    stages = dict(corpus_pipeline.STAGES)
    own = {r[6]: r[3:] for r in rows}
    for name, gone in (("language_id", {3, 4, 5, 6}), ("near_dedup", {2}), ("pii", set())):
        docs = settle(stages[name](spark, docs, DATA), "odd")
        assert docs.columns == [f.split()[0] for f in fields.split(", ")]
        have = docs.collect()
        assert not gone & {r["doc_id"] for r in have} and all(tuple(r)[3:] == own[r["key"]] for r in have)
    ids = [r["doc_id"] for r in have]
    assert ids.count(1) == 1 and ids.count(None) == 2
    assert {r["text"] for r in have if r["doc_id"] is None} == {"no id, mail [EMAIL]"}
    packed = stages["packing"](spark, docs, DATA)
    assert {r["doc_id"] for r in packed.collect()} == set(ids)
    nothing = docs.limit(0)
    for stage in stages.values():
        assert stage(spark, nothing, DATA).count() == 0


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, DATA).collect()] == [1]
