"""Repeated lines whose surroundings differ, and runs across lines without a word."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import linededup

SCHEMA = "doc_id long, text string"
LICENSE = "this text may be copied and shared by all who name its source"


def kept(spark, rows, **limits):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"], r["n_runs"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), **limits).collect()}


def test_runs_go_across_blank_lines(spark):
    rows = [(1, "own one\n\nshared a\n\n \t\nshared b\n\nshared c"), (2, "own two\n\nshared a\n\nshared b\nshared c\n\nown end"), (3, "\n\nshared c\n\nown three\n"), (4, rows_four := "own four\n\n\nown five\n")]
    got = kept(spark, [*rows, (5, rows_four)])
    assert got[1] == (rows[0][1], 8, 0, 0)
    assert got[2] == ("own two\n\n\nown end", 8, 4, 1)
    assert got[3] == (rows[2][1], 6, 0, 0)
    assert got[4] == (rows_four, 5, 0, 0)
    assert got[5] == ("", 5, 4, 1)


def test_single_lines_in_different_surroundings(spark):
    rows = [(1, f"own one\n{LICENSE}\nown two"), (2, f"own three\n{LICENSE}\nshort\nown four"), (3, LICENSE), (4, f"short\nown five\n\n{LICENSE}\n{LICENSE}\nown six"), (5, "own seven\nown one\nown eight")]
    got = kept(spark, rows, min_words=5)
    assert got == {
        1: (rows[0][1], 3, 0, 0),
        2: ("own three\nshort\nown four", 4, 1, 1),
        3: ("", 1, 1, 1),
        4: ("short\nown five\n\nown six", 6, 2, 1),
        5: (rows[4][1], 3, 0, 0),
    }


def test_pipeline_deletes_single_lines(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(1, f"own one\n{LICENSE}\nown two", 0), (2, f"own three\n{LICENSE}\nown four", 0)], "doc_id long, text string, n_chars long")
    assert {tuple(r) for r in corpus_pipeline.cut_lines(spark, docs, "").collect()} == {(1, f"own one\n{LICENSE}\nown two", len(LICENSE) + 16), (2, "own three\nown four", 18)}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_has_words(spark, n):
    lines = ["", " ", "one", " one", "one ", "one two", " one\ttwo three  four ", "a b c d e", " a b c d e f ", "x" * 100_000, "x " * 100_000]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", linededup.has_words(F.col("line"), n)).collect()
    assert all(found == (len(line.split()) >= n) for line, found in got)
