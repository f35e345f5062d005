"""Files of a job: all or none, under stable names."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillspark.sinks import assets


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


ROWS = [("img/a b.png", b"one"), ("x\\c.svg", b"two"), ("img/a b.png", b"one"), ("other/a b.png", b"ONE"), ("", b"nameless"), (None, b"no source"), ("gone.png", None), ("../../.hidden", b"h"), ("empty", b"")]


def test_names_and_contents(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "source string, content binary").repartition(3)
    out = f"file://{tmp_path}/out"
    names = [(r.source, r.name) for r in assets.write_assets(rows, out).collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()[:16]
    want = {("img/a b.png", b"one"): "-a_b.png", ("x\\c.svg", b"two"): "-c.svg", ("other/a b.png", b"ONE"): "-a_b.png", ("", b"nameless"): "", (None, b"no source"): "", ("../../.hidden", b"h"): "-hidden", ("empty", b""): "-empty"}
    want = {(s, f"{sha(b)[:2]}/{sha(b)}{end}"): b for (s, b), end in want.items()}
    assert {n for n in names if n[1]} == {*want} and ("gone.png", None) in names and len(names) == len(ROWS)
    assert tree(tmp_path) == sorted(f"out/{n}" for _, n in want)
    back = {r.name: bytes(r.content) for r in assets.read_assets(spark, out).collect()}
    assert back == {n: b for (_, n), b in want.items() if b}
    # again: the same names; without overwrite the folder that is there stays as it is
    with pytest.raises(Exception, match="out"):
        assets.write_assets(rows.where("source = 'empty'"), out)
    assert tree(tmp_path) == sorted(f"out/{n}" for _, n in want)
    assets.write_assets(rows.where("source = 'empty'"), out, overwrite=True)
    assert tree(tmp_path) == [f"out/{sha(b'')[:2]}/{sha(b'')}-empty"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content")).repartition(8)
    spark.dataSource.register(assets.AssetSource)
    with pytest.raises(Exception, match="broken"):
        rows.write.format("assets").option("path", f"file://{tmp_path}/out").mode("append").save()
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("name", ["/etc/x", "../up", "a/../b", "", "a//b", "dir/"])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    spark.dataSource.register(assets.AssetSource)
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([(name, b"x")], assets.SCHEMA).write.format("assets").option("path", f"file://{tmp_path}/out").mode("append").save()
    assert tree(tmp_path) == []
