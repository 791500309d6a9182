import datetime as dt

import pytest
from pyspark.sql import functions as F

from culprit.functions import html as ht
from culprit.functions.tables import small_table
from culprit.operators import artifact as af
from culprit.operators import differential as df
from culprit.operators import match as mt
from culprit.operators import source_scan as sc
from culprit.operators.rules import RuleSet
from culprit.plans import sources_scan as ps
from culprit.sources import corpus, repository as rp
from culprit.streaming import jobs


def test_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('id, timestamp,message,team\n1,t1,"a\nb ""q""",x\n2,t2,,y\n3,t3,last,\n')
    rows = corpus.read_corpus_csv(spark, str(p), "message", "id", "timestamp", source="s").orderBy("line_num").collect()
    assert [(r["id"], r["raw"], r["timestamp"], r["line_num"]) for r in rows] == [("1", 'a b "q"', "t1", 1), ("2", "", "t2", 2), ("3", "last", "t3", 3)]
    assert rows[0]["fields"] == {"team": "x"} and rows[0]["source"] == "s"
    assert corpus.read_corpus_csv(spark, str(p), "message", join_lines=True).filter("raw LIKE 'a\nb%'").count() == 1
    with pytest.raises(ValueError):
        corpus.read_corpus_csv(spark, str(p), "nope")


def test_history_and_fixtures(spark, tmp_path):
    assert corpus.read_history_lines(spark, str(tmp_path / "absent")).count() == 0
    f = tmp_path / "f.json"
    f.write_text('{"id":"a","raw_log":"x\\r\\n y "}\n{"id":"b","raw_log":"r","normalized_log":"n","fixture_class":"real","fingerprint":"ff"}\n')
    rows = {r["id"]: r for r in corpus.read_fixtures(spark, str(f)).collect()}
    assert rows["a"]["text"] == "x\ny" and rows["a"]["fixture_class"] == "minimal" and len(rows["a"]["fingerprint"]) == 16
    assert rows["b"]["text"] == "n" and rows["b"]["fingerprint"] == "ff"


def test_logs_and_tree(spark, tmp_path):
    for name, text in (("a.go", "x\r\ny"), ("vendor/b.go", "v"), ("s/c.py", "p"), ("s/d.txt", "t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r["path"], r["content"]) for r in rp.read_source_tree(spark, str(tmp_path)).collect()} == {("a.go", "x\ny"), ("s/c.py", "p")}
    assert corpus.read_logs(spark, str(tmp_path)).count() == 4


def test_many_small_files(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"in/d{i}").mkdir(parents=True)
        (tmp_path / f"in/d{i}/f.py").write_text(f"text {i}")
    logs, tree = corpus.read_logs(spark, str(tmp_path / "in")), rp.read_source_tree(spark, str(tmp_path / "in"))
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert logs.rdd.getNumPartitions() <= few and tree.rdd.getNumPartitions() <= few
    assert {r["text"] for r in logs.collect()} == {r["content"] for r in tree.collect()} == {f"text {i}" for i in range(300)}


def test_cluster_sample_files(spark, tmp_path):
    logs = spark.range(200).selectExpr("id AS log_id", "concat('line ', id, '\n', 'of ', id % 40) AS text").repartition(8)
    clusters = logs.groupBy(F.format_string("cluster-%03d", F.col("log_id") % 40).alias("cluster_id")).agg(F.collect_list("log_id").alias("sample_ids"))
    path = tmp_path / "out"
    corpus.write_cluster_samples(clusters, logs, str(path), text="text")
    files = [p for p in path.rglob("*") if p.is_file() and p.parent != path]
    assert len(files) == 40 and {p.parent.name for p in files} == {f"cluster_id=cluster-{i:03d}" for i in range(40)}  # no checksum files, one file each
    rows = corpus.read_cluster_samples(spark, str(path)).collect()
    assert sorted((r["cluster_id"], r["value"]) for r in rows) == sorted((f"cluster-{i % 40:03d}", v) for i in range(200) for v in (f"line {i}", f"of {i % 40}"))


def test_repository_text(spark, tmp_path):
    p = tmp_path / "log"
    p.write_text("\x1fh1\x1e1704067200\x1efix: a\x1eme\n\nx.go\nx.go\ny.go\n\x1fbroken\n\x1fh2\x1e1704067201\x1es\n")
    rows = {r["hash"]: r for r in rp.read_commit_log(spark, str(p)).collect()}
    assert set(rows) == {"h1", "h2"} and rows["h1"]["files"] == ["x.go", "y.go"] and rows["h2"]["author"] == ""
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,2 @@ f\n+a\n@@ -9 +10 @@\n+b\n--- a/y\n+++ /dev/null\n@@ -1 +1 @@\n"
    d = rp.diff_lines(spark.createDataFrame([("r", diff)], "repo string, diff string"))
    assert sorted((r["file"], r["line"]) for r in d.collect()) == [("x", 3), ("x", 4), ("x", 10)]
    s = rp.status_files(spark.createDataFrame([("?? n.go",), (" D d.go",), ("R  a -> b",), ("M",), ("",)], "line string"))
    assert {(r["file"], r["status"]) for r in s.collect()} == {("n.go", "added"), ("d.go", "deleted"), ("b", "modified")}


def test_html(spark):
    page = "<div>a&amp;b<b>c</b>d</div><pre>x  y\n  z</pre><p>one<br>two&nbsp;three</p><!-- no --><ul><li>i</li></ul>"
    assert ht.page_text(page) == "a&b c d\nx  y\nz\none\ntwo three\ni"
    text = "intro\n\n```log\nError: x\n```\ntail\n```\nfine\n```\n```\nError: x\n```"
    row = spark.createDataFrame([(text,), ("ok\n\nit failed\n\n1\n2\n3\n4\n5\n6",)], "t string").select(ht.log_snippets(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in row] == [["Error: x"], ["it failed", "1\n2\n3\n4\n5\n6"]]


def test_differential(spark):
    rules = [
        {"rule_id": "a", "title": "A", "category": "x", "any": ["boom"], "hypothesis": {"support": [("log.contains:boom", 0, "")], "exclude": [("log.contains:fatal", 0, "")]}},
        {"rule_id": "b", "title": "B", "category": "y", "any": ["boom", "bang"], "hypothesis": {"contradict": [("log.absent:calm", 0.2, "")]}},
    ]
    logs = spark.createDataFrame([(0, "boom bang"), (1, "boom fatal")], "log_id int, text string")
    items = df.hypothesis_items(spark, rules)
    sig = df.evaluate_signals(logs, ["log.contains:boom", "log.contains:fatal", "log.absent:calm"])
    a = df.assess(mt.match_rules(logs, RuleSet.from_records(spark, rules)), sig, items)
    got = {(r["log_id"], r["rule_id"]): (r["hypothesis_score"], r["eliminated"], r["new_rank"]) for r in a.collect()}
    assert got == {(0, "a"): (0.9, False, 2), (0, "b"): (1.3, False, 1), (1, "a"): (0.9, True, 2), (1, "b"): (0.3, False, 1)}
    d = {(r["log_id"], r["status"]): r["rule_id"] for r in df.differential(a).collect()}
    assert d == {(0, "likely"): "b", (0, "alternative"): "a", (1, "likely"): "b", (1, "ruled_out"): "a"}


def test_facts(one):
    m = one(lambda c: af.facts(F.lit("missing-executable"), F.lit("make"), F.array(c)), "foo: command not found")
    assert m == {"command_hint": "make", "missing_executable": "foo"}


def test_source_scope_and_scan(spark):
    go = "package x\nfunc (s *S) Handle(in string) {\n\tdb.Query(in)\n\thttp.Get(in)\n}\nvar x = 1\ndb.Query(y)"
    files = spark.createDataFrame([("r", "svc/handler.go", go), ("r", "svc/tests/t.go", "db.Query(z)")], "repo string, path string, content string")
    lines = {r["line"]: (r["function"], r["place"]) for r in sc.line_table(files).filter("path = 'svc/handler.go'").collect()}
    assert lines[3] == ("Handle", "same_block") and lines[5] == ("Handle", "same_block") and lines[6] == ("x", "same_function") and lines[7] == ("", "same_file")
    found = {r["rule_id"]: r for r in sc.scan_sources(files, ps.source_rules(spark)).collect()}
    r = found["raw-query"]
    assert r["base_signal"] == 0.5 + 3 * 1.5 and r["compound_bonus"] == 3.0 + 2.5 and r["change_status"] == "legacy"
    safe = spark.createDataFrame([("r", "a/b.go", "// culprit:ignore raw-query reason=ok until=2030\ndb.Query(x)")], "repo string, path string, content string")
    assert sc.scan_sources(safe, ps.source_rules(spark)).filter("rule_id = 'raw-query'").count() == 0


def test_stream_drops_late_rows_and_dedupes(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame(rows, "id int, text string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    h = lambda n: t + dt.timedelta(hours=n)
    schema = "id int, text string, ts timestamp"
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def drain():
        s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        counts = jobs.windowed_counts(s.withColumns({"failure_id": F.lit("f"), "matched": F.lit(True)}))
        return jobs.drain_to_table(counts, out, cp)

    write("a", [(1, "x", h(0)), (2, "x", h(5))])
    drain()
    write("b", [(3, "late", h(0)), (4, "y", h(9))])
    rows = drain().collect()
    assert sorted((r["window_start"].hour, r["n"]) for r in rows) == [(0, 1), (5, 1)]  # the late row is not counted
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    d = jobs.drain_to_table(jobs.dedupe_stream(s, delay="1 day"), str(tmp_path / "d"), str(tmp_path / "dcp"))
    assert sorted(r["text"] for r in d.collect()) == ["late", "x", "y"]


def test_recurrence_versions(spark, tmp_path):
    sink = jobs.upsert_versions(str(tmp_path / "v"))
    rows = lambda *r: small_table(spark, [dict(zip(("signature_hash", "occurrence_count"), x)) for x in r], {"signature_hash": "string", "occurrence_count": "bigint"})
    sink(rows(("a", 1), ("b", 1)), 0)
    sink(rows(("a", 3)), 1)
    sink(rows(("a", 3)), 1)  # a replayed batch
    got = {r["signature_hash"]: r["occurrence_count"] for r in jobs.latest_versions(spark, str(tmp_path / "v")).collect()}
    assert got == {"a": 3, "b": 1}
