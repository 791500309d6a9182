import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from culprit.operators import changes as ch
from culprit.operators import commits as cm
from culprit.operators import corpus as cp
from culprit.operators import history as hi
from culprit.operators import labelled as lb
from culprit.operators import match as mt
from culprit.operators import owners as ow
from culprit.operators import silent as si
from culprit.operators import source_scan as sc
from culprit.operators import unknown as uk
from culprit.operators.rules import RuleSet


def logs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id int, text string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("make || true", {"ignored-exit-code"}),
        ("allow_failure: true", {"continue-on-error"}),
        ("go test ./...\nno tests found", {"zero-tests-executed"}),
        ("upload artifact x\nNo files found", {"artifact-missing"}),
        ("restore cache\ncache miss", {"cache-miss-non-fatal"}),
        ("step was skipped\ndeploy", {"skipped-critical-step"}),
        ("helm upgrade x\nnothing to deploy", {"empty-deployment-target"}),
        ("run eslint .\n0 files checked", {"empty-quality-check"}),
        ("lint: 0 files checked", set()),  # one line cannot be both the check and the empty result
        ("go test ./... ok", set()),
    ],
)
def test_silent(spark, text, want):
    assert {r["detector"] for r in si.silent_findings(logs(spark, text)).collect()} == want


def test_silent_order_and_limits(spark):
    rows = si.silent_findings(logs(spark, "restore cache\ncache miss\n" + "x || true\n" * 5)).orderBy("rank").collect()
    assert [r["detector"] for r in rows] == ["ignored-exit-code", "cache-miss-non-fatal"]
    assert rows[0]["evidence"] == ["x || true"] * 3


def test_dedupe_and_ingest(spark):
    d = spark.createDataFrame([(3, "b", "s"), (1, "a ", "s"), (2, "a", "s"), (4, "x@y.org", "s"), (5, "z@y.org", "s")], "line_num long, raw string, source string")
    got = {(r["raw"], r["line_num"]) for r in cp.ingest(d).collect()}
    assert got == {("a ", 1), ("b", 3), ("<email>", 4)}
    assert cp.ingest_counts(cp.with_content_id(d)).first().asDict() == {"total": 5, "written": 3, "skipped": 2}


RESULTS = "log_id int, source string, matched boolean, failure_id string, confidence double, error string, evidence array<string>, first_line_tag string, first_line_snippet string"


def result(i, matched=False, failure="", error="", conf=0.0, ev=(), line="x"):
    return (i, "s", matched, failure, conf, error, list(ev), f"tag-{line}", line)


def test_reports(spark):
    base = spark.createDataFrame([result(1, True, "a", conf=0.5, ev=["e"]), result(2), result(3, error="empty fixture"), result(4, True, "b")], RESULTS)
    cur = spark.createDataFrame([result(1, True, "a", conf=0.5, ev=["f"]), result(2, True, "b"), result(4, line="new"), result(9)], RESULTS)
    assert cp.coverage(base).first().asDict() == {"total": 4, "matched": 2, "unmatched": 2, "errors": 1, "match_rate": 0.5}
    diff = {(r["log_id"], r["field"]) for r in cp.determinism_diff(base, cur).collect()}
    assert diff == {(1, "evidence"), (2, "matched"), (2, "failure_id"), (4, "matched"), (4, "failure_id"), (3, "fixture_id"), (9, "fixture_id")}
    assert [r["tag"] for r in cp.new_unmatched_tags(base, cur).collect()] == ["tag-new"]
    gate = cp.quality_gate(base, cur, min_match_rate=0.9, fail_on_drop=True).first()
    assert not gate["pass"] and gate["fail_reasons"] == ["match rate 0.5000 is below minimum 0.9000"]
    assert cp.gap_clusters(base).first()["sample_ids"] == [2]


def test_number_by_count(spark):
    rng = random.Random(1)
    rows = [(f"{rng.getrandbits(32):08x}", rng.choice([1, 1, 1, 2, 7])) for _ in range(500)]
    want = {s: i + 1 for i, (s, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    got = cp.number_by_count(spark.createDataFrame(rows, "signature string, count int").repartition(7)).collect()
    assert {r["signature"]: r["number"] for r in got} == want


def test_corpus_hash_is_order_free(spark):
    d = spark.createDataFrame([(f"{i:03d}",) for i in range(50)], "fixture_id string")
    assert len({cp.corpus_hash(x).first()[0] for x in (d.repartition(1), d.repartition(5), d.orderBy(F.desc("fixture_id")))}) == 1
    assert len({cp.tree_hash(x).first()[0] for x in (d.repartition(1), d.repartition(5))}) == 1


def runs_table(spark, n=300, seed=2):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, rng.choice("pppq"), rng.random() < 0.8, rng.choice("ab"), t0 + dt.timedelta(minutes=rng.randrange(5000))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "run_id int, pipeline string, matched boolean, failure_id string, completed_at timestamp")


def test_stability_blocks_equal_brute_force(spark):
    rows, df = runs_table(spark)
    want = {}
    for p in "pq":
        seq = sorted((r for r in rows if r[1] == p and r[2]), key=lambda r: (r[4], r[0]))
        for i, r in enumerate(seq):
            h = [x[3] for x in seq[max(0, i - 10) : i + 1]]
            want[r[0]] = (len(h), h.count(r[3]))
    for block in (7, 1000):
        got = {r["run_id"]: (r["history_count"], r["seen"]) for r in hi.stability(df, size=10, block=block).collect()}
        assert got == want


def test_health_and_policy(spark):
    d = spark.createDataFrame([("p", True, "b"), ("p", True, "a"), ("p", False, None), ("p", True, "b"), ("p", True, "a"), ("q", True, "a"), ("q", True, "a")], "pipeline string, matched boolean, failure_id string")
    h = {r["pipeline"]: r for r in hi.health(d).collect()}
    assert (h["p"]["fpc"], h["p"]["phi"], h["p"]["top_failure"]) == (0.8, 0.4, "a")  # a tie goes to the smaller id
    assert h["q"]["fpc"] is None and h["q"]["phi"] is None  # too few runs is not zero
    rows = spark.createDataFrame(
        [(1, 0.9, None, None, "high"), (2, 0.9, None, None, "low"), (3, 0.3, None, None, "low"), (4, None, 0.9, 0.5, "low"), (5, 0.1, 0.9, 0.9, "low"), (6, None, None, None, "high"), (7, 0.6, 0.4, 0.1, "low")],
        "id int, tss double, fpc double, phi double, severity string",
    )
    p = {r["id"]: (r["recommendation"], r["basis"]) for r in hi.policy(rows).collect()}
    assert p == {1: ("blocking", ["tss"]), 2: ("quarantine", ["tss"]), 3: ("observe", ["tss"]), 4: ("observe", ["phi"]), 5: ("ok", []), 6: (None, None), 7: ("quarantine", ["tss", "fpc", "phi"])}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(40)]
    texts = []
    for _ in range(25):
        base = rng.sample(pool, rng.randrange(1, 20))
        texts.append("\n".join(base))
        for _ in range(3):
            texts.append("\n".join(l if rng.random() > 0.07 else f"line {rng.randrange(40)}" for l in base))
    texts += [texts[0], texts[0].upper(), " \n", ""]
    sets = [{l.strip() for l in t.lower().split("\n")} - {""} for t in texts]

    def sim(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    got = {r["log_id"]: r for r in lb.review_duplicates(logs(spark, *texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if j != i and u == t]
        near = [j for j in range(len(texts)) if j != i and sim(sets[i], sets[j]) >= lb.NEAR_DUPLICATE]
        status = "duplicate" if same else "near-duplicate" if near else "candidate"
        assert got[i]["status"] == status
        if same:
            assert got[i]["duplicate_of"] == min(same)
        else:
            assert got[i]["near_count"] == len(near)
            assert got[i]["similarity"] == pytest.approx(max(sim(sets[i], sets[j]) for j in range(len(texts)) if j != i))


@pytest.mark.parametrize("common, grid", [(128, 2000), (3, 2), (0, 1), (8, 3)])
def test_best_partners_below_the_threshold(spark, monkeypatch, common, grid):
    monkeypatch.setattr(lb, "COMMON", common)
    monkeypatch.setattr(lb, "GRID", grid)
    rng = random.Random(13)
    plates = [[f"plate {i} {k}" for k in range(3)] for i in range(4)]
    texts = []
    for i in range(130):
        own = [f"own {i} {k}" for k in range(rng.randrange(0, 9))]
        shared = rng.sample([f"shared {k}" for k in range(60)], rng.randrange(0, 4))
        texts.append("\n".join(own + shared + [l for p in rng.sample(plates, rng.randrange(0, 3)) for l in p[: rng.randrange(1, 4)]]))
    texts += ["\n".join(t.split("\n")[:-1]) for t in texts[:20]] + ["", "alone", "plate 0 0"]
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(t.split("\n")) - {""}, i)
    want = {}
    for a, i in sets.items():
        best = max(len(a & b) / len(a | b) if a and b else 0.0 for b, j in sets.items() if j != i)
        want[i] = best
    _, known, ranked = lb.line_sets(logs(spark, *texts))
    got = {r["set_id"]: r["best"] for r in lb.best_partners(known, ranked, lb.near_sets(known, ranked)).collect()}
    assert {i: got.get(i, 0.0) for i in want} == pytest.approx(want)


def test_review_names_the_predicted_rules(spark):
    rules = RuleSet.from_records(spark, [{"rule_id": f"r{i}", "any": ["boom"], "base_score": float(i)} for i in range(5)])
    d = logs(spark, "boom", "nothing", "boom\nagain")
    got = {r["log_id"]: (r["status"], r["predicted_top"], r["predicted_top3"], r["similarity"]) for r in lb.review_duplicates(d, diagnosed=mt.diagnose(d, rules)).collect()}
    assert got == {0: ("candidate", "r4", ["r4", "r3", "r2"], 0.5), 1: ("candidate", None, [], 0.0), 2: ("candidate", "r4", ["r4", "r3", "r2"], 0.5)}


def commits_table(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("r", f"h{i:03d}", t0 + dt.timedelta(hours=i), "Hotfix: x" if i % 9 == 0 else "change", "me", rng.sample([f"d{k % 3}/f{k}.go" for k in range(20)], rng.randrange(1, 15))) for i in range(40)]
    return rows, spark.createDataFrame(rows, "repo string, hash string, ts timestamp, subject string, author string, files array<string>")


def test_co_change_blocks_equal_brute_force(spark, monkeypatch):
    rows, df = commits_table(spark)
    want = {}
    for r in rows:
        for a, b in itertools.combinations(sorted(r[5]), 2):
            want[a, b] = want.get((a, b), 0) + 1
    want = {k: n for k, n in want.items() if n >= 2}
    for block in (4, 2000):
        monkeypatch.setattr(cm, "PAIR_BLOCK", block)
        assert {(r["file_a"], r["file_b"]): r["count"] for r in cm.co_change_pairs(df).collect()} == want


def test_co_change_of_one_very_large_commit(spark, monkeypatch):
    monkeypatch.setattr(cm, "PAIR_BLOCK", 60)
    files = [f"d{i % 7}/f{i}.go" for i in range(700)]
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("r", "large", t0, "s", "a", files), ("r", "next", t0, "s", "a", files[:80]), ("r", "other", t0, "s", "a", files[60:100])]
    df = spark.createDataFrame(rows, "repo string, hash string, ts timestamp, subject string, author string, files array<string>")
    got = {(r["file_a"], r["file_b"]): r["count"] for r in cm.co_change_pairs(df).collect()}
    want = {}
    for some in (files[:80], files[60:100]):
        for a, b in itertools.combinations(sorted(some), 2):
            want[a, b] = want.get((a, b), 1) + 1
    assert got == want


def test_fallback_branches(spark):
    _, df = commits_table(spark)
    pats = cm.failure_patterns(spark, [("hit", "test"), ("miss", "x")], {"hit": ["d1"], "miss": ["nope"]})
    files = cm.relevant_files(df, pats).collect()
    assert all(r["file"].startswith("d1/") for r in files if r["failure_id"] == "hit")
    churn = [r["file"] for r in cm.file_churn(df).orderBy(F.desc("count"), "file").limit(10).collect()]
    assert [r["file"] for r in sorted(files, key=lambda r: r["rank"]) if r["failure_id"] == "miss"] == churn
    assert {r["failure_id"] for r in cm.hotfix_hints(df, pats).collect()} == {"hit", "miss"}
    assert {r["failure_id"] for r in cm.related_commits(df, pats).collect()} == {"hit"}


def test_owners(spark):
    rules = spark.createDataFrame([("r", 0, "*", ["@all"]), ("r", 1, "src/", ["@src"]), ("r", 2, "*.md", ["@docs"]), ("r", 3, "/a/b", ["@ab"])], "repo string, idx int, pattern string, owners array<string>")
    files = spark.createDataFrame([("r", p) for p in ("x.go", "src/x.go", "src/d/y.md", "a/b", "a/b/c.go", "a/bc.go", "q/README.md")], "repo string, path string")
    got = {r["path"]: r["owners"][0] for r in ow.path_owners(files, rules).collect()}
    assert got == {"x.go": "@all", "src/x.go": "@src", "src/d/y.md": "@docs", "a/b": "@ab", "a/b/c.go": "@ab", "a/bc.go": "@all", "q/README.md": "@docs"}
    d = spark.createDataFrame([(["a/b/c.go", "a/b/d/e.go"],), (["a/x.go", "b/y.go"],), (["x.go"],)], "p array<string>")
    assert [r[0] for r in d.select(ow.common_dir(F.col("p"))).collect()] == ["a/b", ".", "."]


def test_topology(spark):
    dirs = spark.createDataFrame([("r", "api", ["@a"]), ("r", "web", ["@w"]), ("r", "api/core", ["@c"])], "repo string, dir string, owners array<string>")
    inc = spark.createDataFrame(
        [("r", "cross", ["api/x.go"], ["web/a/y.go", "web/b.go"]), ("r", "up", ["api/x.go"], ["api/core/z.go"]), ("r", "none", [], ["q/x.go"])],
        "repo string, incident string, changed array<string>, failed array<string>",
    )
    got = {r["incident"]: r["active_signals"] for r in ow.topology_signals(inc, dirs).collect()}
    assert got == {"cross": [ow.BOUNDARY, ow.CLUSTERED, ow.MISMATCH], "up": [ow.BOUNDARY, ow.MISMATCH, ow.UPSTREAM], "none": []}


def test_baseline_equals_brute_force(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, "r", rng.choice("wv"), "main", rng.choice("abc"), rng.choice(["success", "failure"]), t0 + dt.timedelta(hours=rng.randrange(200))) for i in range(200)]
    df = spark.createDataFrame(rows, "run_id int, repo string, workflow string, branch string, sha string, status string, ts timestamp")
    got = {r["run_id"]: r["baseline"]["run_id"] if r["baseline"] else None for r in ch.pick_baseline(df).collect()}
    for c in rows:
        fit = [b for b in rows if b[2] == c[2] and b[5] == "success" and b[4] != c[4] and (b[6], b[0]) < (c[6], c[0])]
        assert got[c[0]] == (max(fit, key=lambda b: (b[6], b[0]))[0] if fit else None)


def test_unknown(spark):
    text = "## header\nError: connection refused by host\nerror: CONNECTION refused by host\nok\nsnapshot expected 1\nstep 2: x"
    c = uk.candidate_patterns(logs(spark, text)).orderBy("rank").collect()
    assert [r["pattern"] for r in c] == ["Error: connection refused by host", "snapshot expected 1", "ok"]
    clusters = {r["category"]: round(r["confidence"], 2) for r in uk.candidate_clusters(uk.candidate_patterns(logs(spark, text))).collect()}
    assert clusters == {"build": 0.45, "network": 0.37, "test": 0.29}


def test_baseline_compares_commits_and_states_without_case(spark):
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [("r", "w", "b", i, sha, status, t + dt.timedelta(hours=i)) for i, (sha, status) in enumerate([("abc", "success"), ("ABC", " Success"), ("abc", "failure"), ("def", "SUCCESS"), ("abc", "failure"), ("Def ", "failure")])]
    runs = spark.createDataFrame(rows, "repo string, workflow string, branch string, run_id int, sha string, status string, ts timestamp")
    got = {r["run_id"]: r["baseline"] and r["baseline"]["run_id"] for r in ch.pick_baseline(runs).collect()}
    assert got == {0: None, 1: None, 2: None, 3: 1, 4: 3, 5: 1}


def test_near_sets_with_a_line_in_every_text_and_a_long_text(spark):
    rng = random.Random(11)
    lines = [f"line {i}" for i in range(400)]
    texts = [["in every text", *rng.sample(lines, rng.randint(1, 12))] for _ in range(120)]
    texts += [t[:-1] + ["changed"] for t in texts[:40] if len(t) > 7]
    long = [f"long {i}" for i in range(20_000)]
    texts += [long, long[50:], long[:9_000]]
    d = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "log_id int, text string")
    members, known, ranked = lb.line_sets(d)
    pairs = lb.near_sets(known, ranked, 0.6)
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(t), i)
    named = [(v, k) for k, v in sets.items()]
    want = {}
    for n, (i, a) in enumerate(named):
        for j, b in named[n + 1 :]:
            s = len(a & b) / len(a | b)
            if s >= 0.6:
                want[min(i, j), max(i, j)] = s
    got = {(r["set_a"], r["set_b"]): r["similarity"] for r in pairs.collect()}
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scope_of_source_lines(spark):
    text = "const start = 1;\r\nfunc (r *T) Run(a int) {\n  if x {\n    y()\n  }\n}\nz()\nfunction go(a) {\n}\n  let b= {\n  c\n}\n"
    files = spark.createDataFrame([("r", "a.go", text), ("r", "b.go", None)], "repo string, path string, content string")
    got = [(r["line"], r["function"], r["depth"]) for r in sc.line_table(files).filter("path = 'a.go'").orderBy("line").collect()]
    names = ["start", "Run", "Run", "Run", "Run", "Run", "", "go", "go", "b", "b", "b", ""]
    assert got == list(zip(range(1, 14), names, [0, 0, 1, 2, 2, 1, 0, 0, 1, 0, 1, 1, 0]))
    assert sc.line_table(files).filter("path = 'b.go'").count() == 1
