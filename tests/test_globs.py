"""Glob and owner indexes against their regexes one by one."""

import random
import re

from pyspark.sql import functions as F

from culprit.functions import paths as pt
from culprit.functions.regex import glob_regex
from culprit.operators import commits as cm
from culprit.operators import globs
from culprit.operators import owners as ow

NAMES = ["a", "ab", "abc", "src", "services", "services-old", "main.go", "main_test.go", "Dockerfile", ".env", ".env.local", "x y", "a[1]", "été.md", "a-very-long-name.yaml"]
OWN = ["a", "/a", "a/", "ab*", "*", "**", "*.go", "main*.go", "?", "??", "a?", "src/**", "**/main.go", "a**go", "src/*", "src/ab", "src/ab/", "s*/ab/main.go", "serv*/", "services/a", "services/", "/services/ab/", "services/ab/ma*", "a[1]", "x y", "*été*", ".env", ".env*", "src/*/main.go", "/", "a/b/c/", "*e*l*"]
GLOBS = ["a", "ab*", "*", "*.go", "main*.go", "?", "a?c", "src/*", "src/ab", "src/*/main.go", "*/ab", ".env*", "a[1]", "*e*l*", "Dockerfile", "services*", "*-old", "*-very-long-name*", "a-very-long-name.yaml"]


def some_paths():
    rng = random.Random(3)
    paths = {"/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 5))) for _ in range(300)}
    return sorted(paths | {"src/ab", "src/ab/c", "src/abc", "services/ab/main.go", "a/b/c", "a/b/cd/e", "/a/b", "a//b", "/"})


def test_owner_rules_as_their_regexes(spark):
    paths = some_paths()
    rules = spark.createDataFrame([("r", i, p, [f"o{i}"]) for i, p in enumerate(OWN)], "repo string, idx int, pattern string, owners array<string>")
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    rx = {r["pattern"]: re.compile(r["rx"]) for r in rules.select("pattern", pt.owner_regex(F.col("pattern")).alias("rx")).collect()}
    fit = {p: [i for i, o in enumerate(OWN) if rx[o].search(p.removeprefix("/"))] for p in paths}
    got = {}
    for r in globs.owner_hits(files, rules).collect():
        got.setdefault(r["path"], set()).add(r["idx"])
    assert got == {p: set(x) for p, x in fit.items() if x}
    last = {r["path"]: r["owners"] for r in ow.path_owners(files, rules).collect()}
    assert last == {p: [f"o{x[-1]}"] if x else None for p, x in fit.items()}


def test_globs_as_their_regexes(spark):
    paths = some_paths()
    files = spark.createDataFrame([(f"r{i % 2}", p) for i, p in enumerate(paths)], "repo string, file string")
    patterns = spark.createDataFrame([(f"f{i % 7}", g) for i, g in enumerate(GLOBS)], "failure_id string, pattern string")
    want = set()
    for i, p in enumerate(paths):
        for j, g in enumerate(GLOBS):
            rx = re.compile(glob_regex(g))
            if rx.search(p) if "/" in g else any(rx.search(s) for s in p.split("/")):
                want.add((f"r{i % 2}", p, f"f{j % 7}"))
    got = [tuple(r) for r in cm.matched_files(files, patterns).select("repo", "file", "failure_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_upstream_by_ancestors(spark):
    rng = random.Random(9)
    dirs = ["a", "a/b", "a/b/c", "ab", "d", "d/e", ""]
    rows = []
    for i in range(80):
        pick = lambda n: [(d + "/" if d else "") + f"f{k}.go" for k, d in enumerate(rng.choice(dirs) for _ in range(n))]
        rows.append(("r", i, pick(rng.randint(0, 3)), pick(rng.randint(0, 3))))
    incidents = spark.createDataFrame(rows, "repo string, incident int, changed array<string>, failed array<string>")
    none = spark.createDataFrame([], "repo string, dir string, owners array<string>")
    at = lambda p: p.rsplit("/", 1)[0] if "/" in p else "."
    want = {i: any(at(c) == "." or at(f) == at(c) or at(f).startswith(at(c) + "/") for c in changed for f in failed) for _, i, changed, failed in rows}
    assert {r["incident"]: r["upstream_changed"] for r in ow.topology_signals(incidents, none).collect()} == want


def test_globs_of_single_failures():
    assert sum(len(ids.split()) for ids in cm.FAILURE_PATTERNS) == 61
    assert cm.patterns_of("go-sum-missing", "build") == ["go.mod", "go.sum"]
    assert cm.patterns_of("oom-killed", "x")[:6] == [".github*", ".gitlab-ci*", ".circleci*", "ci*", "Makefile", "*.sh"]
    assert cm.patterns_of("port-in-use", "network", {"port-in-use": ["a", "a"]}) == ["a"]
    assert cm.patterns_of("protobuf-compile", "")[-3:] == ["*.proto", "buf.gen.yaml", "buf.work.yaml"]  # Makefile is there already
    assert cm.patterns_of("unknown", " Test ")[0] == "*_test.go" and cm.patterns_of("unknown", "") == cm.DEFAULT_PATTERNS
