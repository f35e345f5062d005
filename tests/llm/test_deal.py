"""How work is dealt, whatever the session shuffles into."""

import collections

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspark.llm import packing, shared  # noqa: E402


@pytest.mark.parametrize("n", [8, 51, 200, 256, 4096])
def test_passing_rows_spread(n):
    """The first groups of many tasks, which have equal low bits."""
    counts = collections.Counter(shared.dealt(task << 24, n) for task in range(20 * n))
    assert len(counts) > 0.95 * n and max(counts.values()) <= 60


def test_little_padding_with_many_tasks(spark, tiny):
    docs = spark.read.parquet(f"{tiny.replace('0.001', '0.01')}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    rows = packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(r.length for r in rows) >= 0.98 * 2048 * len({r.sequence_id for r in rows})
