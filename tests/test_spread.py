"""Rows of small files are worked on by many tasks, and texts that many rows have are worked out once."""

from __future__ import annotations

from compare import DATA
from kinolith.operators import line_notation
from kinolith.operators.staging import settled
from kinolith.plans import sequences, structures


def test_small_files_are_not_one_task(spark):
    assert structures.notations(spark, DATA).rdd.getNumPartitions() > 1
    assert sequences.families(spark, DATA).rdd.getNumPartitions() > 1


def test_known_texts_are_worked_out_once():
    line_notation.known_canonical.cache_clear()
    assert {line_notation.known_canonical("C1CC1O") for _ in range(5)} == {line_notation.canonical("C1CC1O")}
    assert line_notation.known_canonical.cache_info().misses == 1


def test_fingerprints_are_worked_out_and_written_once_a_text(spark, monkeypatch):
    written = []

    def noted(frame):
        out = settled(frame)
        written.append(out.count())
        return out

    monkeypatch.setattr(structures, "settled", noted)
    found = structures.circular_fingerprints(spark, DATA)
    texts = structures.notations(spark, DATA).select("smiles").distinct().count()
    assert written and max(written) <= texts < found.count()


def test_ways_of_writing_read_a_text_once():
    line_notation.known_read.cache_clear()
    written = {line_notation.random_text("C1CC(CN)C1O", seed) for seed in range(40)}
    assert len(written) > 1 and line_notation.known_read.cache_info().misses == 1
    assert {line_notation.canonical(w) for w in written} == {line_notation.canonical("C1CC(CN)C1O")}
