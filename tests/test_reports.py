from pyspark.sql import functions as F

from palimpsest.operators import reports
from palimpsest.sources import files


def test_commit_notes(spark):
    messages = ["feat(core): add\n\nBody text\n\n\n\nmore\nSigned-off-by: me", "fix!: break", "perf: fast", "chore: no", "docs: no", "hello", "fix: skip\n\n[skip notes]", "chore: x\n\nBREAKING CHANGE: api"]
    df = spark.createDataFrame(list(enumerate(messages)), "seq long, message string")
    out = reports.classify_commits(df)
    assert [(r.section, r.description) for r in out.orderBy("seq").collect()] == [(1, "add"), (0, "break"), (3, "fast"), (0, "x")]
    lines = [r.line for r in reports.release_notes(out).collect()]
    assert lines == ["BREAKING CHANGES:", "- break", "- x", "New Features:", "- add", "  Body text", "  ", "  more", "Performance:", "- fast"]


def test_merge_findings_and_labels(spark):
    rows = spark.createDataFrame([(1, "k", "t1", "d1", ["a"]), (2, "k", "t2", " ", ["b", "a"]), (3, "k", "t3", "d3", None)], "seq int, key string, title string, detail string, acceptance array<string>")
    r = reports.merge_findings(rows, first=("title",)).first()
    assert (r.title, r.details, r.acceptance) == ("t1", ["d1", "d3"], ["a", "b"])
    assert spark.range(1).select(reports.labels(F.lit("x"), F.lit(""), F.lit("maintenance"), F.lit("s"))).first()[0] == ["maintenance", "maintenance:x", "s"]


def test_upserts_close_only_when_complete(spark):
    p, i = spark.createDataFrame([("A",), ("b",)], "key string"), spark.createDataFrame([("a", 1, "closed"), ("c", 2, "open"), ("d", 3, "closed")], "key string, number int, state string")
    part = {(r.key, r.action) for r in reports.upserts(p, i).collect()}
    assert part == {("A", "reopen"), ("b", "create")}
    assert {(r.key, r.action) for r in reports.upserts(p, i, complete=True).collect()} == part | {("c", "close")}


def test_file_scans(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<p><x Include="A" Version="1"/><x Include="B"/><t>net9</t></p>')
    (tmp_path / "t.md").write_text("# t\n\n| Method | Size |\n| --- | ---: |\n| M1 | Small |\n| M2 | Large |\n")
    xml = files.whole_files(spark, str(tmp_path), "*.xml")
    assert [(r.Include, r.Version) for r in files.xml_attributes(xml, "x", ["Include", "Version"]).orderBy("n").collect()] == [("A", "1"), ("B", None)]
    assert [r.value for r in files.xml_values(xml, "t").collect()] == ["net9"]
    assert [r.match for r in files.matches(xml, 'Include="(.)"').orderBy("n").collect()] == ["A", "B"]
    md = files.markdown_tables(files.whole_files(spark, str(tmp_path), "*.md"), ["Size", "Method", "None"])
    assert [(r.Size, r.Method, r["None"]) for r in md.orderBy("n").collect()] == [("Small", "M1", None), ("Large", "M2", None)]
    ranked = spark.createDataFrame([("Large",), ("zz",), ("Small",)], "s string")
    assert [r.s for r in ranked.orderBy(reports.rank_of(F.col("s"), ["Small", "Medium", "Large"])).collect()] == ["Small", "Large", "zz"]
    (tmp_path / "log").write_text("feat: a\0fix: b\0")
    assert files.commit_log(spark, str(tmp_path / "log")).count() == 2
    (tmp_path / "p.jsonl").write_text('{"a":1}\n[2]\n')
    assert [r.payload for r in files.payloads(spark, str(tmp_path / "p.jsonl")).collect()] == ['{"a":1}', "[2]"]
    (tmp_path / "c.json").write_text('{\n "k": [1, 2]\n}')
    assert files.json_files(spark, str(tmp_path / "c.json"), "k array<int>").first().k == [1, 2]
    files.write_lines(spark.createDataFrame([("x",)], "line string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "x"
