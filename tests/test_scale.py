"""Steps that must not grow faster than their input, and tables that come as folders of files."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from culprit.functions import scopes
from culprit.functions import text as tx
from culprit.operators import match as mt
from culprit.operators import pattern_index
from culprit.operators import rerank as rr
from culprit.operators.rules import RuleSet
from culprit.functions.tables import small_table
from culprit.plans import reasoning
from culprit.streaming import jobs


def fnv(t):
    h = 2166136261
    for b in t.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"


def test_fnv_of_long_texts_is_linear(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé€ x") for _ in range(rng.choice([0, 1, 40, 300]))) for _ in range(500)] + ["ü" * 300_000, "", None]
    began = time.time()
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.fnv1a32(F.col("t")).alias("h")).collect()
    assert {r["i"]: r["h"] for r in got} == {i: None if t is None else fnv(t) for i, t in enumerate(texts)}
    assert time.time() - began < 30


def test_table_of_several_files_as_a_stream(spark, tmp_path):
    d = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id int, text string")
    d.repartition(4).write.parquet(f"{tmp_path}/many.parquet")
    d.coalesce(1).write.parquet(f"{tmp_path}/parts")
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "one.parquet")
    for name in ("many", "one"):
        out = jobs.drain_to_table(jobs.table_stream(spark, f"{tmp_path}/{name}.parquet", d.schema, 3), f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-cp")
        assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))


def test_shared_file_lists_score_like_lists_of_each_log(spark):
    rules = RuleSet.from_records(spark, [
        {"rule_id": "npm-lock", "title": "t", "category": "ci", "likely_files": ["*.json", "go.mod"], "any": ["boom"]},
        {"rule_id": "runtime", "title": "u", "category": "runtime", "likely_files": [], "any": ["boom", "bang"]},
    ])
    logs = spark.createDataFrame([(i, "boom bang") for i in range(6)], "log_id int, text string")
    files = spark.createDataFrame([(0, ["a/package.json", "x.py"], ["go.mod"]), (1, ["go.sum", ".github/workflows/a.yml"], None), (2, None, [])], "context_id int, changed_files array<string>, recent_files array<string>")
    none = F.array().cast("array<string>")
    context = logs.filter("log_id < 5").select(
        "log_id", (F.col("log_id") % 4).alias("context_id"), *[none.alias(c) for c in rr.CONTEXT_COLUMNS[2:]], F.lit("").alias("command"), F.lit("").alias("step"), F.lit("").alias("top_cause"))
    counts, ranked = small_table(spark, [], {"rule_id": "string", "n": "int"}), mt.match_rules(logs, rules)
    shared = rr.score_features(ranked, rules, counts, context, files=files)
    own = rr.score_features(ranked, rules, counts, context.join(files, "context_id", "left").drop("context_id"))
    rows = lambda d: sorted(map(str, d.select("log_id", "rule_id", "prior", "features").collect()))
    assert rows(shared) == rows(own) and len(rows(own)) == 12


def test_every_part_is_in_a_change_context(spark, tmp_path):
    """In the rows and in the statement: no part is left out because its number is beyond the users'."""
    spark.createDataFrame([(i, f"x {i}", "T", i % 6) for i in range(1, 4001)], "p_partkey bigint, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 7, "error", 1.0, "", "2024-01-01 00:00:00")], "event_id bigint, user_id bigint, event_type string, value double, props string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    files, context = reasoning._context(spark, str(tmp_path))
    held = files.select(F.explode(F.array_union("changed_files", "recent_files")).alias("f")).distinct().count()
    assert files.count() == 40 and held > 1000 and context.first()["context_id"] == 7
    assert "p_partkey % 40 AS k" in reasoning.RERANK


def test_sanitiser_counts_run_each_step_once(spark):
    texts = ["a@b.org c@d.org password=x", "Authorization: Bearer abc https://u:p@h/", "", None, "plain"]
    d = spark.createDataFrame(list(enumerate(texts)), "log_id int, text string")
    got = tx.sanitize_rows(d)
    want = d.select("log_id", F.explode(tx.sanitize_counts(F.col("text"))).alias("c")).select("log_id", "c.rule", "c.n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 3
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= len(tx.SANITIZERS) and plan.count("regexp_extract_all") + plan.count("regexp_count") <= len(tx.SANITIZERS)


def test_a_line_is_kept_once_for_all_its_pieces(spark):
    words = [f"word{i} " for i in range(3000)]
    line = "".join(words)
    norms = [w + v for w, v in zip(words, words[1:])] + ["".join(words[i : i + 4]).strip() for i in range(0, 2900, 7)] + ["word1", "nothing of it at all"]
    index = pattern_index.PatternIndex.build(spark.createDataFrame([(n,) for n in norms], "norm string"))
    texts = pa.array([line, None, line + "\nsecond " + line])
    found = pattern_index.surroundings(texts, texts, index.filter(), index.reach)
    assert found.nbytes < 100 * len(line)  # a copy of the line for each piece would be over 10,000 times
    hits = mt.find_hits(spark.createDataFrame([(0, line, line)], "log_id int, norm string, canonical string"), index, ["log_id"])
    assert {(r["norm"], r["line_no"], r["line"]) for r in hits.collect()} == {(n, 1, line) for n in norms if n in line}


def test_surroundings_of_a_piece_at_the_ends_of_lines(spark):
    texts = ["abcdefgh\nxabcdefghijklmnopqy\nabcdefghijklmnop", "é" * 9 + "\n" + "é" * 8, "abcdefghi" * 3 + "\n" + "abcdefghi" * 2]
    norms = ["abcdefghijklmnop", "abcdefghijklmnopq", "abcdefghi", "é" * 8, "é" * 9, "abcdefghiabcdefghi", "hiabcdefghia", "ijklmnopqrs"]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "log_id int, norm string, canonical string")
    got = mt.find_hits(rows, spark.createDataFrame([(n,) for n in norms], "norm string"), ["log_id"]).collect()
    want = {(i, n, next(k for k, l in enumerate(t.split("\n"), 1) if n in l)) for i, t in enumerate(texts) for n in norms if any(n in l for l in t.split("\n"))}
    assert {(r["log_id"], r["norm"], r["line_no"]) for r in got} == want and len(got) == len(want)


def test_rows_of_a_part_leave_a_scan_before_the_next_part(spark, monkeypatch):
    norms = ["ab", "needle in a long text", "çé"]
    index = pattern_index.PatternIndex.build(spark.createDataFrame([(n,) for n in norms], "norm string"))
    texts = [None, "ab", "", "x" * 30 + "\nneedle in a long text", "çé ab\n" * 9, "çé", None, "y" * 50, "ab\nçé"]
    made, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: made.append(f) or real(f, kind))
    index.hits(F.col("norm"), F.col("canonical"))
    scopes.lines_with_pieces(index.filter(), F.col("norm"), F.col("content"))
    monkeypatch.setattr(pattern_index, "PART", 40)
    batch, read = pa.array(texts), []
    for run in made:
        out = run((read.append(1) or b) for b in [(batch, batch), (batch[:0], batch[:0]), (batch, batch)])
        found = [next(out)]
        assert 0 < len(found[0]) < len(texts) and read == [1]  # rows of one part, while the rest of the batch waits
        found += out
        assert len(found) > 6 and sum(map(len, found)) == 2 * len(texts) and len(read) == 3
        read.clear()
        if run is made[0]:
            whole = pattern_index.surroundings(batch, batch, index.filter(), index.reach).to_pylist()
            assert [x for f in found for x in f.to_pylist()] == whole * 2

    long = [*texts, *("z" * 3_000_000 + f"\nab {i}\nneedle in a long text" for i in range(3)), "ab"]
    rows = spark.createDataFrame([(i, t, t) for i, t in enumerate(long)], "log_id int, norm string, canonical string").coalesce(1)
    got = mt.find_hits(rows, index, ["log_id"]).collect()
    want = {(i, n, next(l for l in t.split("\n") if n in l)) for i, t in enumerate(long) for n in norms if n in (t or "")}
    assert {(r["log_id"], r["norm"], r["line"]) for r in got} == want and len(got) == len(want)


def test_mode_summary_evaluates_each_mode_once(spark, monkeypatch):
    from culprit.plans import labelled

    columns = "log_id int, expected_rank int, labelled boolean, unmatched boolean, false_positive boolean, weak_match boolean"
    rows, written = [(1, 1, True, False, False, False), (2, 0, True, True, False, False), (3, 2, True, False, True, False), (4, 1, False, False, False, False)], []
    modes = iter([rows, [(1, 2, *rows[0][2:]), (2, 1, *rows[1][2:]), *rows[2:]]])
    monkeypatch.setattr(labelled, "evaluated", lambda *_: spark.createDataFrame(next(modes), columns))
    monkeypatch.setattr(labelled, "stored", lambda d: written.append(d) or d)
    r = labelled.mode_summary(spark, "").first()
    assert (r["improved"], r["regressed"], r["unchanged"]) == (1, 1, 1) and len(written) == 2


def test_source_texts_are_scanned_once(spark, monkeypatch):
    from culprit.plans import demo, sources_scan

    guarded, bare = 'func a(input string) {\n\tdb.Query("x" + input)\n\tvalidate(input)\n}', 'func b(input string) {\n\tdb.Query("y" + input)\n}'
    files = spark.createDataFrame([("r0", "mod1/examples/a.go", guarded), ("r0", "mod1/examples/b.go", bare), ("r0", "mod1/examples/c.go", None)], "repo string, path string, content string")
    monkeypatch.setattr(demo, "source_files", lambda *_: files)
    got = sources_scan.source_signals(spark, "")
    assert {(r["kind"], r["signal_id"], r["path"][-4:], r["line"]) for r in got.collect()} == {
        ("trigger", "query", "a.go", 2), ("trigger", "query", "b.go", 2), ("mitigation", "validated", "a.go", 3), ("amplifier", "peers", "b.go", 2)}
    for d in (got, sources_scan.source_compounds(spark, "")):
        assert "EvalPython" not in d._jdf.queryExecution().optimizedPlan().toString()  # the scan is behind a table


def test_co_change_pairs_are_formed_once_for_hints(spark):
    from culprit.operators import commits as cm

    lists = [["a/x_test.go", "go.mod", "b.py"], ["go.mod", "a/x_test.go"], ["b.py", "c.py"], ["c.py", "b.py"], ["d.py", "go.mod"]]
    commits = spark.createDataFrame([("r", f"h{i}", x) for i, x in enumerate(lists)], "repo string, hash string, files array<string>")
    patterns = spark.createDataFrame([("lock", "go.mod"), ("lock", "*_test.go"), ("python", "c.*"), ("none", "d.py")], "failure_id string, pattern string")
    got = cm.co_change_hints(cm.co_change_pairs(commits), patterns)
    assert sorted(map(tuple, got.collect())) == [("r", "lock", 1, "a/x_test.go <-> go.mod"), ("r", "python", 1, "b.py <-> c.py")]
    assert "block_a" not in got._jdf.queryExecution().optimizedPlan().toString()  # the pairing is behind a table


def test_candidate_lines_are_cleaned_and_lowered_once(spark):
    from culprit.operators import unknown as uk

    texts = ["Fatal: no such É\nfatal: no such é\n\n ## x\nok", "", " \n\t\r\n", None, "## only noise", "ok"]
    got = uk.candidate_patterns(spark.createDataFrame(list(enumerate(texts)), "log_id int, text string"))
    assert sorted((r["log_id"], r["rank"], r["pattern"], r["score"]) for r in got.collect()) == [(0, 1, "Fatal: no such É", 6), (0, 2, "ok", -2), (5, 1, "ok", -2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<tmp>") == 1 and plan.count("StartsWith(lower(") == 0


def test_an_index_sends_no_pieces_through_the_driver(spark, monkeypatch):
    """However small the planner takes the tables for: there are several pieces to a pattern, and its files say little of rows."""
    norms = [f" w{i} of w{i % 7} " for i in range(40)] + ["ab", "ü" * 9, None, ""]
    plans, real = [], pattern_index.stored
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(pattern_index, "stored", lambda d: plans.append(plan(d)) or real(d))
    monkeypatch.setattr(pattern_index, "MANY", 10, raising=False)
    index = pattern_index.PatternIndex.build(spark.createDataFrame([(n,) for n in norms], "norm string"))
    texts = ["x ab w3 of w3 y", "ü" * 12 + " w39 of w4 ", None, ""]
    logs = spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "log_id int, norm string, canonical string")
    got = mt.find_hits(logs, index, ["log_id"])
    assert {(r["log_id"], r["norm"]) for r in got.collect()} == {(i, n) for i, t in enumerate(texts) for n in norms if n and n in (t or "")}
    assert plans and not any("Broadcast" in p for p in [*plans, plan(got)])
