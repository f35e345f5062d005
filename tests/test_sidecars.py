"""Sidecars and trees of reports on small files and tables."""

from quillspark.sinks import sidecars
from quillspark.sources.reports import latest_reports, read_reports


def test_reports_of_a_tree(spark, tmp_path):
    for run, text in (("a", '{"stage": "done",\n "cost": 1.5}'), ("b", '{"stage": "half'), ("c", "{}")):
        (tmp_path / "x" / run).mkdir(parents=True)
        (tmp_path / "x" / run / "report.json").write_text(text)
    (tmp_path / "x" / "a" / "other.json").write_text('{"stage": "no"}')
    got = latest_reports(read_reports(spark, str(tmp_path), "stage string, cost double")).orderBy("run").collect()
    assert [(r.run, r.stage, r.cost, r.is_broken) for r in got] == [("a", "done", 1.5, False), ("b", None, None, True), ("c", None, None, False)]


def test_sidecar(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, None), (1, 1, 2, "c"), (1, 1, 2, "c"), (2, 0, 0, "a")], "doc_id long, page long, idx int, text string")
    found = sidecars.nodes(rows)
    assert sorted((r.doc_id, r.kind, r.place) for r in found.collect()) == [(1, "block", 0), (1, "block", 1), (1, "block", 2), (1, "document", 0), (1, "page", 0), (1, "page", 1), (2, "block", 0), (2, "document", 0), (2, "page", 0)]
    assert sorted((r.doc_id, r.relation) for r in sidecars.relations(found).collect()) == [(1, "holds")] * 5 + [(1, "precedes")] * 2 + [(2, "holds")] * 2
    sums = {r.doc_id: r.checksum for r in sidecars.checksums(found).collect()}
    again = {r.doc_id: r.checksum for r in sidecars.checksums(sidecars.nodes(rows.where("text is null or text != 'c'"))).collect()}
    assert sums[2] == again[2] and sums[1] != again[1]
    sidecars.write_sidecar(rows, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s" / "nodes")).count() == 9 and spark.read.json(str(tmp_path / "s" / "checksums")).count() == 2
    assert sidecars.nodes(rows.limit(0)).count() == 0
