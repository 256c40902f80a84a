"""What a Python worker keeps between tasks."""

from __future__ import annotations

from collections import Counter

import public_tokenizers

from kinolith.llm import language_id, near_dedup, shared, token_counts

WORD_BPE = "word_bpe_49k.json"


def test_one_operator_at_a_time_has_a_cache(spark):
    path = public_tokenizers.path(WORD_BPE)
    docs = spark.createDataFrame([(1, "one two three four five six", "en")], "doc_id long, text string, lang string").coalesce(1)
    model = language_id.Model(["en"], {"en": language_id.grams_of(Counter([b"one"]))})

    def names(frame):
        def held(batches):
            import pyarrow as pa

            for _ in batches:
                pass
            yield pa.RecordBatch.from_arrays([pa.array([n.split()[0] for n in shared._KEPT], pa.string())], names=["name"])

        return [r["name"] for r in frame.coalesce(1).mapInArrow(held, "name string").collect()]

    shared.forget()
    first = token_counts.encoder(path)
    assert token_counts.encoder(path) is first and [n.split()[0] for n in shared._KEPT] == ["tokens"]
    shared.kept("scorer x", lambda: language_id.Scorer(model))
    assert list(shared._KEPT) == ["scorer x"]
    shared.forget()
    assert not shared._KEPT
    # in a worker as well: near-duplicate search leaves nothing of the tokens
    token_counts.count_tokens(docs, path).collect()
    near_dedup.set_table(docs, "doc_id").collect()
    assert names(docs) == []
