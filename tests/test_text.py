import hashlib
import re

import pytest
from pyspark.sql import functions as F

from culprit.functions import classify as cl
from culprit.functions import paths as pt
from culprit.functions import signature as sg
from culprit.functions import stage as st
from culprit.functions import text as tx
from culprit.functions.regex import glob_regex, jvm


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a\r\nb\rc", "a\nb\nc"),
        ("  x \t y  \n\n \n z", "x y\nz"),
        ("\x1b[31mred\x1b[0m", "red"),
        ("at 2024-01-02T03:04:05.678+01:00 ok", "at <timestamp> ok"),
        ("at 2024-01-02T03:04:05Z ok", "at 2024-01-02T03:04:05Z ok"),  # upper-case Z is kept
        ("2024/01/02 03:04:05 x", "<timestamp> x"),
        ("t 03:04:05.1 x", "t <timestamp> x"),
        ("see /tmp/abc/d.txt: bad", "see <tmp>: bad"),
        (r"C:\Users\bob\AppData\Local\Temp\x1 y", "<tmp> y"),
        ("id 123e4567-e89b-12d3-a456-426614174000!", "id <id>!"),
        ("é12:13:14", "é<timestamp>"),  # word boundaries are ASCII
        ("a\u00a0\u2003b", "a b"),
        ("", ""),
    ],
)
def test_canonicalize(one, raw, want):
    assert one(tx.canonicalize_log, raw) == want
    lines = [one(tx.clean_line, l) for l in re.split("\r\n|\r|\n", raw)]
    assert "\n".join(l for l in lines if l) == want


def test_regex_dialect():
    assert jvm(r"\s") == r"[\t\n\f\r ]"
    assert jvm(r"[^\s:]") == r"[^\t\n\f\r :]"
    assert re.fullmatch(glob_regex("a?c*.txt"), "abcd.txt") and not re.fullmatch(glob_regex("*.txt"), "d/x.txt")


def test_hashes(one):
    assert one(tx.fnv1a32, "") == "811c9dc5"
    assert one(tx.fnv1a32, "a") == "e40c292c"
    assert one(tx.fnv1a32, "foobar") == "bf9cf968"
    assert one(tx.content_id, " x ") == hashlib.sha256(b"x").hexdigest()
    assert one(tx.fixture_fingerprint, "x") == hashlib.sha256(b"x").digest()[:8].hex()


def test_round2(spark):
    got = spark.range(1).select(*[tx.round2(F.lit(v)).alias(str(i)) for i, v in enumerate((1.005, 2.675, -1.255, 0.125))]).first()
    assert got[0] == 1.0 and got[3] == 0.13


def test_size(one):
    assert [tx.parse_size(s) for s in ("", "0", "10", "2kb", "3 MB", "1gb", "7b")] == [0, 0, 10, 2048, 3 << 20, 1 << 30, 7]
    with pytest.raises(ValueError):
        tx.parse_size("x1")
    assert one(lambda c: tx.cap_size(c, 4), "abcdef") == "abcd" + tx.TRUNCATION_MARK
    assert one(lambda c: tx.cap_size(c, 4), "abcé") == "abc" + tx.TRUNCATION_MARK  # no half code point
    assert one(lambda c: tx.cap_size(c, 5), "abcé") == "abcé"


def test_redaction(one):
    assert one(tx.redact, "mail a.b@c.org now") == "mail <email> now"
    assert one(tx.redact, "Bearer abc.def=") == "<token>"
    assert one(tx.redact, "ghp_" + "a" * 36) == "<token>"
    assert one(tx.sanitize, "https://u:p@h/x") == "https://<redacted>:<redacted>@h/x"
    assert one(tx.sanitize, "password = hunter2 x") == "password = <redacted> x"
    counts = one(tx.sanitize_counts, "a@b.org c@d.org password=x")
    assert {(c["rule"], c["n"]) for c in counts} == {("credential-kv", 1), ("email", 2)}


def test_context(one):
    log = "start\n##[group] Build it\n$ npm test\nkubectl apply"
    assert one(lambda c: st.log_stage(F.lower(c)), log) == "build"
    assert one(st.log_step, log) == "Build it"
    assert one(st.log_command, log) == "npm test"
    assert one(lambda c: st.log_stage(F.lower(c)), "nothing") == ""


@pytest.mark.parametrize(
    "path, want",
    [
        ("/tmp/a/b/c.txt:12:3", "<tmp>/b/c.txt:<n>:<n>"),
        ("/home/runner/work/app/app/src/main.go", "<workspace>/app/src/main.go"),
        ("/opt/hostedtoolcache/go/1.2/x64", "<runner>/go/1.2/x64"),
        ("/home/dev/p/q.py", "<home>/dev/p/q.py"),
        ("/srv/a/b/c/d", "<path>/b/c/d"),
        (r"C:\Users\bob\AppData\Local\Temp\x\y", "<tmp>/x/y"),
        ("rel/path:9", "rel/path:<n>"),
    ],
)
def test_generalize_path(one, path, want):
    assert one(pt.generalize_path, path) == want


def test_signature_ignores_noise(one):
    a = "2024-01-01T10:00:00Z ERROR pid 123 at /tmp/run1/x/main.go:10:2 id 1a2b3c4d5e from 10.0.0.1"
    b = "2025-02-03T11:22:33Z ERROR pid 99 at /tmp/run9/x/main.go:77 id ffffffffff from 10.9.8.7"
    assert one(sg.normalize_evidence_line, a) == one(sg.normalize_evidence_line, b)


def test_classifiers(one):
    assert one(pt.changed_file_class, "a/go.mod") == "dependency"
    assert one(pt.changed_file_class, ".github/workflows/x.yml") == "ci_config"
    assert one(pt.changed_file_class, "src/x_test.go") == "test_data"
    assert one(pt.changed_file_class, "README") is None
    cls = lambda c: cl.gap_class(c)[0]
    assert one(cls, "docker image failed") == "container-runtime"
    assert one(lambda c: cl.gap_class(c)[1], "unauthorized token") == 0.85
    assert one(lambda c: cl.gap_class(c)[1], "token and 503, timeout tcp") == 0.425  # the first class with any hit wins
    assert one(cl.failing_test, "--- FAIL: TestX (0.1s)") == "TestX"
    assert one(cl.failing_test, "FAILED  a/b.py::t - boom") == "a/b.py::t"
    assert one(cl.failing_test, "● suite › case") == "suite › case"
    assert one(cl.fix_steps, "intro\n1. one\n- two\n10. ten\n * no") == ["one", "two"]
    assert [cl.lookback_interval(s) for s in ("30d", "2w", "1m", "1y", "x", "0d", "7")] == [
        "INTERVAL 30 DAYS", "INTERVAL 2 WEEKS", "INTERVAL 1 MONTHS", "INTERVAL 1 YEARS", "INTERVAL 30 DAYS", "INTERVAL 30 DAYS", "INTERVAL 7 DAYS",
    ]
    assert one(cl.missing_executable, 'exec "/usr/bin/foo": no such file or directory') == {"missing_executable": "foo", "expected_path": "/usr/bin/foo"}
