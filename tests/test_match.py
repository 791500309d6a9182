import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from culprit.operators import match as mt
from culprit.operators import pattern_index
from culprit.operators import rules as ru
from culprit.operators import trace as tr
from culprit.operators.rules import RuleSet
from culprit.plans import demo


def logs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "log_id int, text string")


def ranked(spark, rules, *texts):
    rows = mt.match_rules(logs(spark, *texts), RuleSet.from_records(spark, rules)).collect()
    return {(r["log_id"], r["rule_id"]): r for r in rows}


def test_scoring(spark):
    rules = [
        {"rule_id": "any", "any": ["boom", "shared"], "base_score": 0.5, "stage_hints": ["Test"]},
        {"rule_id": "all", "all": ["one", "two"]},
        {"rule_id": "half", "all": ["one", "missing"]},
        {"rule_id": "none", "any": ["boom"], "none": ["pytest"]},
        {"rule_id": "kofn", "partial": [{"minimum": 2, "patterns": ["one", "two", "zzz"]}, {"minimum": 2, "patterns": ["boom", "yyy"]}]},
        {"rule_id": "idf", "any": ["shared"]},
    ]
    r = ranked(spark, rules, "pytest run\nBOOM   here\none shared\ntwo\none again")
    assert r[0, "any"]["score"] == 0.5 + 0.5 + 0.5 + 0.75  # boom and shared are listed by two rules each
    assert r[0, "all"]["score"] == 2 * 1.5 + 2.0 and r[0, "all"]["evidence"] == ["one shared", "two"]
    assert r[0, "half"]["score"] == 1.5
    assert (0, "none") not in r
    assert r[0, "kofn"]["score"] == 3 * 0.75 + 1.0
    assert r[0, "idf"]["score"] == 0.5
    assert r[0, "all"]["rank"] == 1


def test_confidence_ties(spark):
    base = [{"rule_id": i, "any": [p], "base_score": s} for i, p, s in (("a", "x1", 2.0), ("b", "x2", 2.0), ("c", "x3", 0.0))]
    r = ranked(spark, base, "x1 x2 x3")
    assert [r[0, i]["confidence"] for i in "abc"] == [0.38, 0.38, 0.25]
    r = ranked(spark, [{"rule_id": "a", "any": ["x1"], "base_score": 3.5}, {"rule_id": "b", "any": ["x2"], "base_score": 1.0}], "x1 x2")
    assert [r[0, i]["confidence"] for i in "ab"] == [0.69, 0.33]


def test_empty_and_unmatched(spark):
    rows = mt.evaluate_logs(logs(spark, "", " \n\x1b[0m", "nothing", "boom"), RuleSet.from_records(spark, [{"rule_id": "r", "any": ["boom"]}])).collect()
    got = {r["log_id"]: (r["matched"], r["error"], r["failure_id"]) for r in rows}
    assert got == {0: (False, "empty fixture", ""), 1: (False, "empty fixture", ""), 2: (False, "", ""), 3: (True, "", "r")}


def test_several_rule_sets_in_one_scan(spark, tmp_path, monkeypatch):
    from culprit.plans import corpus

    texts = ["the the que und der", "MIT License | ### ***", "", " les que eau é tion", "licensed under cc by-nc 4.0", "plain", None]
    rows = [(i, t, "s") for i, t in enumerate(texts * 2)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    apart = [corpus.results(spark, str(tmp_path), RuleSet.from_records(spark, r)) for r in (demo.RULES[:-1], demo.RULES[1:])]
    want = [sorted(map(str, d.collect())) for d in apart]
    find, scans = mt.find_hits, []
    monkeypatch.setattr(mt, "find_hits", lambda *a, **k: scans.append(1) or find(*a, **k))
    got = [sorted(map(str, d.collect())) for d in corpus._two(spark, str(tmp_path))]
    assert got == want and want[0] != want[1] and len(scans) == 1


def _hits(df):
    return sorted((r["log_id"], r["norm"], r["line_no"], r["line"]) for r in df.collect())


def brute_hits(texts, norms):
    return sorted(
        (i, p, n + 1, l)
        for i, t in enumerate(texts) for p in set(norms)
        for n, l in [next(((n, l) for n, l in enumerate((t or "").split("\n")) if p in l.lower()), (None, None))] if p and n is not None
    )


def test_hits(spark):
    texts = ["a b\nhe she\nhers\nabab é\nerrör she", "", "she\nhe", "x" * 50 + "\nabab", None, "longer than eight no\nlonger than eight bytes\nand longer than eight bytes again", "ab\nab"]
    norms = ["he", "she", "hers", "abab", "ab", "é", "errör", "zzz", "a b", "x", "", "longer than eight bytes", "longer than", "than eight b", "t bytes a", "b\nhe", "b a", "x" * 50, "x" * 49, "x" * 51, "abab é"]
    table = spark.createDataFrame([(p,) for p in norms + norms[:3]], "norm string")
    assert _hits(mt.first_pattern_lines(logs(spark, *texts), table)) == brute_hits(texts, [p for p in norms if "\n" not in p])


def test_hits_of_many_patterns_over_parts_of_a_batch(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcé ") for _ in range(n)).strip() or "a"
    texts = ["\n".join(" ".join(make(rng.randint(1, 30)).split()) for _ in range(rng.randint(1, 9))).strip() for _ in range(60)]
    texts = ["\n".join(x for x in t.split("\n") if x) for t in texts]
    norms = [" ".join(make(rng.randint(1, 20)).split()) for _ in range(1500)] + [t[3:21].split("\n")[0].strip() for t in texts]
    table = spark.createDataFrame([(p,) for p in norms], "norm string")
    want = brute_hits(texts, norms)
    prepared = logs(spark, *texts).withColumn("canonical", F.col("text")).withColumn("norm", F.lower("text"))
    for size in (pattern_index.AT_ONCE, 7, 64):
        index = pattern_index.PatternIndex.build(table)
        monkeypatch.setattr(pattern_index, "AT_ONCE", size)
        rows = prepared.select("log_id", "norm", "canonical").toArrow()
        found = pattern_index.scan(rows["norm"].combine_chunks(), rows["canonical"].combine_chunks(), index.filter()).to_pylist()
        patterns = {}
        for r in index.table.collect():
            patterns.setdefault((r["code"], r["piece"]), []).append(r["norm"])
        got = {}
        for i, hits in zip(rows["log_id"].to_pylist(), found, strict=True):
            for h in hits:
                for p in patterns.get((h["code"], h["piece"]), []):
                    if p in h["line"].lower():
                        got[i, p] = min(got.get((i, p), (1 << 30, "")), (h["line_no"], h["line"]))
        assert sorted((i, p, *at) for (i, p), at in got.items()) == want
    assert _hits(mt.find_hits(prepared, table, ["log_id"])) == want


def test_filter_of_all_ones_changes_nothing(spark):
    texts = ["one two\nthree", "four", ""]
    index = pattern_index.PatternIndex.build(spark.createDataFrame([("two",), ("three four five",), ("three",)], "norm string"))
    full = {b: b"\xff" * 4096 for b in range(1, 2**index.width // 32768 + 1)}
    prepared = mt.prepare_logs(logs(spark, *texts))
    assert _hits(mt.find_hits(prepared, dataclasses.replace(index, bits=full), ["log_id"])) == brute_hits(texts, ["two", "three"])


def test_no_patterns_and_no_logs(spark):
    none = spark.createDataFrame([], "norm string")
    assert mt.first_pattern_lines(logs(spark, "a"), none).count() == 0
    assert mt.find_hits(mt.prepare_logs(logs(spark, "a", "b")), none, ["log_id"], outer=True).count() == 2
    assert mt.first_pattern_lines(logs(spark, "a").limit(0), spark.createDataFrame([("a",)], "norm string")).count() == 0


def test_many_rules_keep_logs_without_hits(spark):
    rules = RuleSet.from_records(spark, [{"rule_id": f"r{i}", "any": [f"pattern number {i}x"]} for i in range(600)])
    rows = mt.evaluate_logs(logs(spark, "pattern number 3x pattern number 1x", "pattern number", "none"), rules).collect()
    assert {(r["log_id"], r["failure_id"]) for r in rows} == {(0, "r1"), (1, ""), (2, "")}


@pytest.mark.parametrize("records", [demo.RULES, demo.CI_RULES])
def test_own_patterns_rank_first(spark, records):
    texts = []
    for r in records:
        lines = r.get("any", []) + r.get("all", []) + [p for g in r.get("partial", []) for p in g["patterns"]]
        texts.append("\n".join(lines))
    rows = mt.match_rules(logs(spark, *texts), RuleSet.from_records(spark, records)).filter("rank = 1").collect()
    assert {r["log_id"]: r["rule_id"] for r in rows} == {i: r["rule_id"] for i, r in enumerate(records)}


def test_partitioning_does_not_matter(spark):
    texts = [("boom one\n" * (i % 5)) + "two " * (i % 3) + "the the" for i in range(60)]
    rules = RuleSet.from_records(spark, [{"rule_id": f"r{k}", "any": ["boom", "the the"][: k % 2 + 1], "all": ["two"]} for k in range(4)])
    answers = []
    for n in (1, 4, 17):
        df = mt.match_rules(logs(spark, *texts).repartition(n), rules)
        answers.append(sorted(map(str, df.collect())))
    assert answers[0] == answers[1] == answers[2]


def test_rule_table(spark):
    good = RuleSet.from_records(spark, [{"rule_id": "a", "title": "t", "fix": "f", "any": ["x"]}])
    assert ru.check_rules(good).count() == 0
    with pytest.raises(ValueError):
        ru.load_rules(good.rules.union(good.rules), good.patterns)
    bad = RuleSet.from_records(
        spark,
        [
            {"rule_id": "b", "title": "", "fix": "f", "any": ["x", " X "], "all": ["x"], "none": ["x"], "partial": [{"minimum": 3, "patterns": ["q"]}]},
            {"rule_id": "c", "title": "t", "fix": "f", "none": ["y"]},
            {"rule_id": "d", "title": "t", "fix": "f", "any": [" ", "see /tmp/abc"]},
        ],
    )
    problems = {(r["rule_id"], r["problem"]) for r in ru.check_rules(bad).collect()}
    assert problems == {
        ("b", "missing field"), ("b", "k of n out of bounds"), ("b", "pattern listed twice"), ("b", "pattern both positive and excluded"),
        ("c", "no matcher"), ("d", "empty pattern"), ("d", "pattern is masked by the line normaliser"),
    }
    assert good.explain("a").count() == 1 and good.explain("z").count() == 0


def test_trace_masks_patterns(spark):
    rules = RuleSet.from_records(spark, [{"rule_id": "r", "any": ["/tmp/abc failed"]}])
    log = logs(spark, "/tmp/zzz failed")
    assert mt.match_rules(log, rules).count() == 0
    t = tr.trace_rules(log, rules).first()
    assert t["status"] == "matched" and t["lines"] == ["<tmp> failed"]
    assert mt.unmatched(mt.evaluate_logs(log, rules)).count() == 1


def test_reasons_from_counts_equal_those_of_the_trace(spark):
    log = logs(spark, *["\n".join(r.get("any", [])[:1] + r.get("none", [])[: i % 2] + [p for g in r.get("partial", []) for p in g["patterns"]][: i % 4]) for i, r in enumerate(demo.RULES)], "", None)
    rules = RuleSet.from_records(spark, demo.RULES + [{"rule_id": "odd", "any": ["the the", " "], "all": ["the the", "the the"], "partial": [{"minimum": 1, "patterns": ["|", "|"]}]}])
    ranked_pairs = mt.match_rules(log, rules)
    rows = lambda df: sorted((r["log_id"], r["rule_id"], r["ranked"], r["why"]) for r in df.collect())
    got = rows(tr.rule_reasons(log, rules, ranked_pairs))
    assert got == rows(tr.trace_reasons(tr.trace_rules(log, rules), ranked_pairs)) and len(got) == 12 * 11
