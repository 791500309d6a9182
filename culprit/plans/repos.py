"""Queries on commits, owners and changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.functions import classify as cl
from culprit.functions.regex import glob_regex
from culprit.functions.storage import stored
from culprit.operators import changes as ch
from culprit.operators import commits as cm
from culprit.operators import owners as ow
from culprit.operators.ordered import last_before, time_bucket
from culprit.plans import demo, sql
from culprit.plans.demo import COMMITS_SQL, FILES_SQL
from culprit.plans.sql import any_of, collapse, lit, trim_space
from culprit.plans.texts import (
    CI_CONFIG_SQL, CONFIG_SQL, FAILING_SQL, SALIENT_SQL, class_reason_sql, class_weight_sql, file_class_sql,
)

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


C = f"WITH {COMMITS_SQL}"
DIR = "CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') ELSE '' END"
CHURN = ", churn AS (SELECT repo, file, count(*) AS count FROM cf GROUP BY 1, 2)"
DIRS = f", dirs AS (SELECT repo, {DIR.format(c='file')} AS dir, count(*) AS count FROM cf WHERE contains(file, '/') GROUP BY 1, 2)"
HOT = any_of("lower(subject)", cl.HOTFIX_WORDS)
REV = any_of("lower(subject)", cl.REVERT_WORDS)
DATE = "strftime(ts, '%Y-%m-%d')"


def day(c="ts"):
    return F.date_format(c, "yyyy-MM-dd")


@register("file_churn", C + CHURN + " SELECT * FROM churn")
def file_churn(spark, sf):
    return cm.file_churn(demo.commits(spark, sf))


@register("dir_churn", C + DIRS + " SELECT * FROM dirs")
def dir_churn(spark, sf):
    return cm.dir_churn(demo.commits(spark, sf))


@register("repeated_files", C + CHURN + DIRS + " SELECT repo, file AS name, count FROM churn WHERE count >= 2 UNION ALL SELECT repo, dir, count FROM dirs WHERE count >= 2")
def repeated_files(spark, sf):
    c = demo.commits(spark, sf)
    files = cm.repeated(cm.file_churn(c)).withColumnRenamed("file", "name")
    return files.unionByName(cm.repeated(cm.dir_churn(c)).withColumnRenamed("dir", "name"))


@register("marked_commits", C + f" SELECT repo, hash, {HOT} AS hotfix, {REV} AS revert, len(files) >= 10 AS large, {DATE} AS date FROM commits WHERE {HOT} OR {REV} OR len(files) >= 10")
def marked_commits(spark, sf):
    c = demo.commits(spark, sf)
    flags = c.withColumns({"hotfix": cl.is_hotfix(F.col("subject")), "revert": cl.is_revert(F.col("subject")), "large": F.size("files") >= cm.LARGE_COMMIT})
    return flags.filter("hotfix OR revert OR large").select("repo", "hash", "hotfix", "revert", "large", day().alias("date"))


@register("lookback_commits", C + " SELECT repo, hash FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 14 DAY")
def lookback_commits(spark, sf):
    from culprit.functions.tables import with_row

    c = demo.commits(spark, sf)
    d = with_row(c.select("repo", "hash", "ts"), c.agg(F.max("ts").alias("now")))
    return d.filter(cl.within_lookback(F.col("ts"), F.col("now"), "2w")).select("repo", "hash")


@register(
    "co_change_pairs",
    C + " SELECT a.repo, a.file AS file_a, b.file AS file_b, count(*) AS count FROM cf a JOIN cf b ON a.repo = b.repo AND a.hash = b.hash AND a.file < b.file GROUP BY 1, 2, 3 HAVING count(*) >= 2",
)
def co_change_pairs(spark, sf):
    return cm.co_change_pairs(stored(demo.commits(spark, sf)))


@register("config_churn", C + CHURN + f", p AS (SELECT repo, file AS path, count FROM churn) SELECT repo, path AS file, count, {CONFIG_SQL} AS is_config, {CI_CONFIG_SQL} AS is_ci_config FROM p WHERE {CONFIG_SQL} OR {CI_CONFIG_SQL}")
def config_churn(spark, sf):
    return cm.config_churn(cm.file_churn(demo.commits(spark, sf)))


@register("top_authors", C + """, a AS (SELECT repo, author, count(*) AS count FROM commits WHERE author <> '' GROUP BY 1, 2), n AS (SELECT repo, count(*) AS author_count FROM a GROUP BY 1)
SELECT repo, author, count, author_count, row_number() OVER (PARTITION BY repo ORDER BY count DESC, author) AS rank FROM a JOIN n USING (repo) QUALIFY rank <= 5""")
def top_authors(spark, sf):
    c = demo.commits(spark, sf)
    return cm.top_authors(c).join(cm.distinct_authors(c), "repo").withColumn("rank", F.col("rank").cast("bigint"))


RECENT = """, fm AS (SELECT repo, file, min((-epoch_us(ts), hash, pos)) AS place FROM cf GROUP BY 1, 2),
 recent AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY place) AS rank, file FROM fm QUALIFY rank <= 10)"""


@register("recent_files", C + RECENT + " SELECT * FROM recent")
def recent_files(spark, sf):
    return cm.recent_files(demo.commits(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


def _patterns(spark):
    return cm.failure_patterns(spark, demo.FAILURES, demo.OWN_PATTERNS)


def _pattern_rows():
    rows = []
    for f, c in demo.FAILURES:
        for g in cm.patterns_of(f, c, demo.OWN_PATTERNS):
            rows.append([f, glob_regex(g)])
    return sql.values("pats", ["failure_id", "rx"], rows)


M = f"""{C}, {_pattern_rows()}, pairs AS (SELECT repo, failure_id FROM (SELECT DISTINCT repo FROM commits), (SELECT DISTINCT failure_id FROM pats)),
 df AS (SELECT DISTINCT file FROM cf), hits AS (SELECT DISTINCT file, failure_id FROM df, pats WHERE regexp_matches(file, rx) OR len(list_filter(string_split(file, '/'), lambda s: regexp_matches(s, rx))) > 0),
 mf AS (SELECT cf.*, failure_id FROM cf JOIN hits USING (file))"""


def _rank(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "relevant_files",
    M + CHURN + """, d AS (SELECT repo, failure_id, row_number() OVER (PARTITION BY repo, failure_id ORDER BY place, file) AS rank, file
   FROM (SELECT repo, failure_id, file, min((-epoch_us(ts), hash)) AS place FROM mf GROUP BY 1, 2, 3) QUALIFY rank <= 10),
 f AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY count DESC, file) AS rank, file FROM churn QUALIFY rank <= 10)
SELECT * FROM d UNION ALL SELECT p.repo, p.failure_id, f.rank, f.file FROM pairs p JOIN f USING (repo) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repo = p.repo AND d.failure_id = p.failure_id)""",
)
def relevant_files(spark, sf):
    return _rank(cm.relevant_files(stored(demo.commits(spark, sf)), _patterns(spark)))


MC = ", mcm AS (SELECT DISTINCT repo, failure_id, hash, ts, subject FROM mf)"


@register("related_commits", M + MC + f" SELECT repo, failure_id, row_number() OVER (PARTITION BY repo, failure_id ORDER BY ts DESC, hash) AS rank, left(hash, 7) AS hash, subject, {DATE} AS date FROM mcm QUALIFY rank <= 5")
def related_commits(spark, sf):
    return _rank(cm.related_commits(stored(demo.commits(spark, sf)), _patterns(spark)))


def _fallback(direct, fb, col):
    return f"SELECT repo, failure_id, rank, {col} FROM {direct} UNION ALL SELECT p.repo, p.failure_id, f.rank, f.{col} FROM pairs p JOIN {fb} f USING (repo) WHERE NOT EXISTS (SELECT 1 FROM {direct} d WHERE d.repo = p.repo AND d.failure_id = p.failure_id)"


@register(
    "hotspot_dirs",
    M + DIRS + f""", d AS (SELECT repo, failure_id, dir, row_number() OVER (PARTITION BY repo, failure_id ORDER BY n DESC, dir) AS rank FROM
  (SELECT repo, failure_id, {DIR.format(c='file')} AS dir, count(*) AS n FROM mf WHERE contains(file, '/') GROUP BY 1, 2, 3) QUALIFY rank <= 5),
 fb AS (SELECT repo, dir, row_number() OVER (PARTITION BY repo ORDER BY count DESC, dir) AS rank FROM dirs QUALIFY rank <= 5) """ + _fallback("d", "fb", "dir"),
)
def hotspot_dirs(spark, sf):
    return _rank(cm.hotspot_dirs(stored(demo.commits(spark, sf)), _patterns(spark)))


@register(
    "co_change_hints",
    M + """, pr AS (SELECT a.repo, a.file AS file_a, b.file AS file_b, count(*) AS count FROM cf a JOIN cf b ON a.repo = b.repo AND a.hash = b.hash AND a.file < b.file GROUP BY 1, 2, 3 HAVING count(*) >= 2),
 ph AS (SELECT DISTINCT repo, failure_id, file_a, file_b, count FROM pr JOIN hits h ON h.file IN (pr.file_a, pr.file_b))
SELECT repo, failure_id, row_number() OVER (PARTITION BY repo, failure_id ORDER BY count DESC, file_a, file_b) AS rank, file_a || ' <-> ' || file_b AS hint FROM ph QUALIFY rank <= 3""",
)
def co_change_hints(spark, sf):
    return _rank(cm.co_change_hints(cm.co_change_pairs(stored(demo.commits(spark, sf))), _patterns(spark)))


@register(
    "hotfix_hints",
    M + MC + f""", d AS (SELECT repo, failure_id, row_number() OVER (PARTITION BY repo, failure_id ORDER BY ts DESC, hash) AS rank, subject AS hint FROM mcm WHERE {HOT} QUALIFY rank <= 5),
 fb AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rank, subject AS hint FROM commits WHERE {HOT} QUALIFY rank <= 5) """ + _fallback("d", "fb", "hint"),
)
def hotfix_hints(spark, sf):
    return _rank(cm.hotfix_hints(stored(demo.commits(spark, sf)), _patterns(spark)))


@register(
    "drift_hints",
    M + MC + CHURN + DIRS + f""", rd AS (SELECT DISTINCT h.failure_id, c.repo, c.dir, c.count FROM dirs c JOIN mf h ON h.repo = c.repo AND starts_with(h.file, c.dir || '/') WHERE c.count >= 2),
 allh AS (SELECT repo, failure_id, 0 AS part, -epoch_us(ts) AS o1, hash AS o2, subject AS hint FROM mcm WHERE {REV}
  UNION ALL SELECT repo, failure_id, 1, -count, dir, 'Repeated edits in ' || dir FROM rd
  UNION ALL SELECT c.repo, h.failure_id, 2, -c.count, c.file, 'Repeated edits in ' || c.file FROM churn c JOIN hits h USING (file) WHERE c.count >= 2),
 d AS (SELECT repo, failure_id, row_number() OVER (PARTITION BY repo, failure_id ORDER BY part, o1, o2) AS rank, hint FROM allh QUALIFY rank <= 5),
 fb AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rank, subject AS hint FROM commits WHERE {REV} QUALIFY rank <= 5) """ + _fallback("d", "fb", "hint"),
)
def drift_hints(spark, sf):
    return _rank(cm.drift_hints(stored(demo.commits(spark, sf)), _patterns(spark)))


@register(
    "change_hints",
    C + CHURN + f""", p AS (SELECT repo, file AS path, count FROM churn)
SELECT repo, 'config' AS kind, row_number() OVER (PARTITION BY repo ORDER BY count DESC, path) AS rank, path AS hint FROM p WHERE {CONFIG_SQL} QUALIFY rank <= 5
UNION ALL SELECT repo, 'ci_config', row_number() OVER (PARTITION BY repo ORDER BY count DESC, path) AS rank, path FROM p WHERE {CI_CONFIG_SQL} QUALIFY rank <= 5
UNION ALL SELECT repo, 'large_commit', row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rank, format('{{}} ({{}} files)', subject, len(files)) FROM commits WHERE len(files) >= 10 QUALIFY rank <= 5""",
)
def change_hints(spark, sf):
    return _rank(cm.change_hints(stored(demo.commits(spark, sf))))


@register(
    "plain_context",
    C + DIRS + RECENT + f""", dr AS (SELECT repo, 0 AS part, -epoch_us(ts) AS o1, hash AS o2, subject AS value FROM commits WHERE {REV} UNION ALL SELECT repo, 1, -count, dir, 'Repeated edits in ' || dir FROM dirs WHERE count >= 2)
SELECT repo, 'recent_file' AS kind, rank, file AS value FROM recent
UNION ALL SELECT repo, 'hotspot_dir', row_number() OVER (PARTITION BY repo ORDER BY count DESC, dir) AS rank, dir FROM dirs QUALIFY rank <= 5
UNION ALL SELECT repo, 'hotfix', row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rank, subject FROM commits WHERE {HOT} QUALIFY rank <= 5
UNION ALL SELECT repo, 'drift', row_number() OVER (PARTITION BY repo ORDER BY part, o1, o2) AS rank, value FROM dr QUALIFY rank <= 5
UNION ALL SELECT repo, 'commit', row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rank, left(hash, 7) || ' ' || {DATE} || ' ' || subject FROM commits QUALIFY rank <= 5""",
)
def plain_context(spark, sf):
    return _rank(cm.plain_context(stored(demo.commits(spark, sf))))


# Owner rules: one per supplier nation and region, later rules win.
OWNER_RULES = [
    ("*", ["@all"]), ("src/", ["@core", "@lead"]), ("*.tf", ["@infra"]), ("/deploy/", ["@ops"]), ("docs/**", ["@docs"]), ("src/api", ["@api"]),
    ("app/*/economy/", ["@app"]), ("go.mod", ["@deps"]), ("src/tests/**/red_*", ["@red"]), ("src/core/small/?lue_bolt*", ["@blue"]),
]
FREE = [0, 1]  # parts of these repos are not covered by the catch-all


def _owner_rows(spark, sf):
    from culprit.functions.tables import small_table

    rows = [{"repo": f"r{k}", "idx": i, "pattern": p, "owners": o} for k in range(4) for i, (p, o) in enumerate(OWNER_RULES) if not (k in FREE and p == "*")]
    return small_table(spark, rows, {"repo": "string", "idx": "int", "pattern": "string", "owners": "array<string>"})


def _owner_sql():
    """One hand-written condition per rule."""
    conds = {
        "*": "true", "src/": "starts_with(p, 'src')", "*.tf": "ends_with(p, '.tf')", "/deploy/": "starts_with(p, 'deploy')",
        "docs/**": "starts_with(p, 'docs/')", "src/api": "(p = 'src/api' OR starts_with(p, 'src/api/'))",
        "app/*/economy/": "starts_with(p, 'app/*/economy')", "go.mod": "regexp_matches(p, '(^|/)go\\.mod$') OR starts_with(p, 'go.mod/')",
        "src/tests/**/red_*": "regexp_matches(p, '^src/tests/.*/red_[^/]*$')", "src/core/small/?lue_bolt*": "regexp_matches(p, '^src/core/small/[^/]lue_bolt[^/]*$')",
    }
    out = "CASE"
    for p, o in reversed(OWNER_RULES):
        extra = " AND repo NOT IN ('r0', 'r1')" if p == "*" else ""
        out += f" WHEN ({conds[p]}){extra} THEN {lit('|'.join(o))}"
    return out + " END"


OF = f"WITH {FILES_SQL}, rf AS (SELECT DISTINCT concat('r', p_partkey % 4) AS repo, path FROM files)"


def _repo_files(spark, sf):
    return demo.files(spark, sf).select(F.concat(F.lit("r"), F.col("p_partkey") % 4).alias("repo"), "path").distinct()


@register("path_owners", OF + f", x AS (SELECT repo, path, path AS p FROM rf) SELECT repo, path, {_owner_sql()} AS owners FROM x")
def path_owners(spark, sf):
    o = ow.path_owners(_repo_files(spark, sf), _owner_rows(spark, sf))
    return o.withColumn("owners", F.array_join("owners", "|"))


DIRS_SQL = f""", pd AS (SELECT DISTINCT repo, array_to_string(string_split(path, '/')[1:k], '/') AS dir, k FROM rf, (VALUES (1), (2)) t(k) WHERE len(string_split(path, '/')) > k),
 od AS (SELECT repo, dir, k, coalesce((SELECT {_owner_sql().replace('repo NOT IN', 'pd.repo NOT IN')} FROM (SELECT dir || '/' AS p)), (SELECT {_owner_sql().replace('repo NOT IN', 'pd.repo NOT IN')} FROM (SELECT dir AS p))) AS owners FROM pd),
 owned AS (SELECT * FROM od WHERE owners IS NOT NULL)"""


@register("owned_dirs", OF + DIRS_SQL + " SELECT repo, dir, owners FROM owned")
def owned_dirs(spark, sf):
    return ow.owned_dirs(_repo_files(spark, sf), _owner_rows(spark, sf)).withColumn("owners", F.array_join("owners", "|"))


@register(
    "nearest_owners",
    OF + DIRS_SQL + ", n AS (SELECT f.repo, f.path, arg_max(o.owners, o.k) AS owners FROM rf f JOIN owned o ON o.repo = f.repo AND starts_with(f.path, o.dir || '/') GROUP BY 1, 2) SELECT rf.repo, rf.path, n.owners FROM rf LEFT JOIN n USING (repo, path)",
)
def nearest_owners(spark, sf):
    files = _repo_files(spark, sf)
    n = ow.nearest_owners(files, ow.owned_dirs(files, _owner_rows(spark, sf)))
    return n.withColumn("owners", F.array_join("owners", "|"))


INCIDENT = """inc AS (SELECT concat('r', p_size % 4) AS repo, concat('i', p_partkey // 40) AS incident,
  list(path ORDER BY p_partkey) FILTER (WHERE p_partkey % 3 = 0) AS c0, list(path ORDER BY p_partkey) FILTER (WHERE p_partkey % 3 <> 0) AS f0 FROM (SELECT p_partkey, p_size, FPATH AS path FROM part) GROUP BY 1, 2),
 incidents AS (SELECT repo, incident, coalesce(c0, []) AS changed, coalesce(f0, []) AS failed FROM inc)""".replace("FPATH", demo.FILE_PATH)


def _incidents(spark, sf):
    f = demo.table(spark, sf, "part").select("p_partkey", "p_size", F.expr(demo.FILE_PATH).alias("path"))

    def paths(cond):
        return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("p_partkey", "path")))), lambda x: x["path"])

    changed = F.col("p_partkey") % 3 == 0
    return f.groupBy(F.concat(F.lit("r"), F.col("p_size") % 4).alias("repo"), F.concat(F.lit("i"), F.floor(F.col("p_partkey") / 40)).alias("incident")).agg(
        paths(changed).alias("changed"), paths(~changed).alias("failed"))


def _d(c):
    return f"CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '/[^/]*$', '') ELSE '.' END"


@register(
    "topology_signals",
    OF + DIRS_SQL.replace("FROM rf,", "FROM (SELECT DISTINCT concat('r', p_size % 4) AS repo, FPATH AS path FROM part) rf,").replace("FPATH", demo.FILE_PATH) + f""", {INCIDENT},
 x AS (SELECT repo, incident, 'c' AS kind, unnest(changed) AS path, generate_subscripts(changed, 1) AS pos FROM incidents UNION ALL SELECT repo, incident, 'f', unnest(failed), generate_subscripts(failed, 1) FROM incidents),
 y AS (SELECT x.*, (SELECT arg_max(o.owners, o.k) FROM owned o WHERE o.repo = x.repo AND starts_with(x.path, o.dir || '/')) AS owners FROM x),
 z AS (SELECT repo, incident, kind, pos, path, string_split(owners, '|') AS os FROM y),
 g AS (SELECT repo, incident, list_sort(list_distinct(flatten(list(os) FILTER (WHERE kind = 'c' AND os IS NOT NULL)))) AS co, list_distinct(flatten(list(os) FILTER (WHERE kind = 'f' AND os IS NOT NULL))) AS fo,
   max(os) FILTER (WHERE kind = 'c' AND pos = 1) AS c1, max(os) FILTER (WHERE kind = 'f' AND pos = 1) AS f1,
   count(*) AS n FROM z GROUP BY 1, 2),
 s AS (SELECT i.repo, i.incident, coalesce(co, []) AS co, coalesce(fo, []) AS fo, c1, f1, list_transform(changed, lambda p: {_d('p')}) AS cd, list_transform(failed, lambda p: {_d('p')}) AS fd FROM incidents i LEFT JOIN g USING (repo, incident)),
 r AS (SELECT repo, incident, co, len(co) > 0 AND len(fo) > 0 AND len(list_intersect(co, fo)) = 0 AS crossed, c1 IS NOT NULL AND f1 IS NOT NULL AND len(list_intersect(c1, f1)) = 0 AS mismatch,
   len(list_filter(cd, lambda a: len(list_filter(fd, lambda d: a = '.' OR d = a OR starts_with(d, a || '/'))) > 0)) > 0 AS upstream,
   len(fd) >= 2 AND len(list_distinct(list_transform(fd, lambda d: string_split(d, '/')[1]))) = 1 AND fd[1] <> '.' AS clustered FROM s)
SELECT repo, incident, array_to_string(co, '|') AS owner_zones, crossed AS boundary_crossed, clustered AS failure_clustered, mismatch AS ownership_mismatch, upstream AS upstream_changed FROM r""",
)
def topology_signals(spark, sf):
    inc = _incidents(spark, sf)
    listing = demo.table(spark, sf, "part").select(F.concat(F.lit("r"), F.col("p_size") % 4).alias("repo"), F.expr(demo.FILE_PATH).alias("path")).distinct()
    s = ow.topology_signals(inc, ow.owned_dirs(listing, _owner_rows(spark, sf)))
    return s.select("repo", "incident", F.array_join("owner_zones", "|").alias("owner_zones"), "boundary_crossed", "failure_clustered", "ownership_mismatch", "upstream_changed")


# Changes: days of a user's event log; the day before is the baseline.
DAYS = f"""{demo.EVENT_LOGS_SQL}, days AS (SELECT *, lag(text) OVER (PARTITION BY split_part(log_id, '-', 1) ORDER BY log_id) AS base FROM event_logs)"""


def _names(text, e):
    return f"list_filter(list_distinct(list_transform(list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda l: {trim_space('l')}), lambda l: l <> ''), lambda line: {e})), lambda x: x IS NOT NULL)"


@register(
    "log_delta",
    f"""WITH {DAYS}, d AS (SELECT log_id, {_names('text', FAILING_SQL)} AS ct, {_names('base', FAILING_SQL)} AS bt, {_names('text', SALIENT_SQL)} AS ce, {_names('base', SALIENT_SQL)} AS be FROM days)
SELECT log_id, array_to_string(list_sort(list_filter(ct, lambda x: NOT list_contains(bt, x))), '|') AS tests_newly_failing, array_to_string(list_sort(list_filter(ce, lambda x: NOT list_contains(be, x))), '|') AS errors_added FROM d""",
)
def log_delta(spark, sf):
    r = ch.successive_deltas(demo.event_logs(spark, sf), F.substring_index("log_id", "-", 1))
    return r.select("log_id", F.array_join("tests_newly_failing", "|").alias("tests_newly_failing"), F.array_join("errors_added", "|").alias("errors_added"))


CI_RUNS = """SELECT event_id AS run_id, concat('repo', user_id % 3) AS repo, concat('wf', user_id % 4) AS workflow, CASE WHEN user_id % 5 = 0 THEN 'dev' ELSE 'main' END AS branch,
 concat('sha', event_id % 6, user_id % 2) AS sha, CASE WHEN event_type IN ('view', 'click') THEN 'success' ELSE 'failure' END AS status, ts, event_type AS event, event_id % 3 AS attempt FROM events"""


def _ci_runs(spark, sf):
    demo.events(spark, sf).createOrReplaceTempView("ci_events")
    return spark.sql(CI_RUNS.replace("FROM events", "FROM ci_events"))


@register(
    "baseline_runs",
    f"""WITH r AS ({CI_RUNS}) SELECT c.run_id, (SELECT arg_max(b.run_id, (b.ts, b.run_id)) FROM r b WHERE b.repo = c.repo AND b.workflow = c.workflow AND b.branch = c.branch AND b.status = 'success'
 AND b.sha <> c.sha AND (b.ts, b.run_id) < (c.ts, c.run_id)) AS baseline_id FROM r c""",
)
def baseline_runs(spark, sf):
    return ch.pick_baseline(_ci_runs(spark, sf)).select("run_id", F.col("baseline.run_id").alias("baseline_id"))


@register(
    "environment_diff",
    f"""WITH r AS ({CI_RUNS}), p AS (SELECT *, lag(event) OVER w AS e0, lag(attempt) OVER w AS a0, lag(branch) OVER w AS b0 FROM r WINDOW w AS (PARTITION BY repo, workflow ORDER BY ts, run_id))
SELECT run_id, CASE WHEN coalesce(b0, '') <> branch THEN 'branch:' || coalesce(b0, '') || '>' || branch || ';' ELSE '' END
 || CASE WHEN coalesce(e0, '') <> event THEN 'event:' || coalesce(e0, '') || '>' || event || ';' ELSE '' END
 || CASE WHEN coalesce(a0::VARCHAR, '') <> attempt::VARCHAR THEN 'run_attempt:' || coalesce(a0::VARCHAR, '') || '>' || attempt || ';' ELSE '' END AS diff FROM p""",
)
def environment_diff(spark, sf):
    settings = ("branch", "event", "attempt")
    r = _ci_runs(spark, sf)
    p = last_before(r, ["repo", "workflow"], ["ts", "run_id"], time_bucket(F.col("ts"), "day"), F.struct(*settings), "earlier")
    p = p.select("run_id", *settings, *[F.col("earlier")[c].alias(c + "0") for c in settings])
    names = {"branch": "branch", "event": "event", "run_attempt": "attempt"}
    d = p.withColumn("d", ch.env_diff({k: F.col(v + "0") for k, v in names.items()}, {k: F.col(v) for k, v in names.items()}))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("d")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["baseline"], F.lit(">"), e["value"]["current"], F.lit(";"))), "")
    return d.select("run_id", text.alias("diff"))


@register(
    "cause_buckets",
    f"""{C}, x AS (SELECT DISTINCT repo || ':' || strftime(ts, '%Y-%m') AS change_id, file FROM cf), y AS (SELECT change_id, {file_class_sql('file')} AS kind FROM x),
 w AS (SELECT change_id, kind, {class_weight_sql('kind')} AS w, {class_reason_sql('kind')} AS reason FROM y WHERE kind IS NOT NULL
  UNION ALL SELECT repo || ':' || strftime(ts, '%Y-%m'), 'environment', 0.25, 'hotfix signal present' FROM commits WHERE {HOT} OR {REV}
  UNION ALL SELECT repo || ':' || strftime(ts, '%Y-%m'), 'environment', 0.15, 'revert signal present' FROM commits WHERE ({HOT} OR {REV}) AND contains(lower(subject), 'revert')),
 g AS (SELECT change_id, kind, round(sum(w) * 100) / 100 AS score, list_sort(list_distinct(list(reason))) AS reasons FROM w GROUP BY 1, 2)
SELECT change_id, kind, score::DOUBLE AS score, array_to_string(reasons, '|') AS reasons, row_number() OVER (PARTITION BY change_id ORDER BY score DESC, kind) AS rank FROM g WHERE score > 0""",
)
def cause_buckets(spark, sf):
    c = demo.commits(spark, sf).withColumn("change_id", F.concat("repo", F.lit(":"), F.date_format("ts", "yyyy-MM")))
    files = c.select("change_id", F.explode("files").alias("file"))
    marked = c.filter(cl.is_hotfix(F.col("subject")) | cl.is_revert(F.col("subject")))
    r = ch.cause_buckets(files, marked.select("change_id", F.lit("hotfix").alias("kind"), F.col("subject").alias("text")))
    return r.select("change_id", "kind", "score", F.array_join("reasons", "|").alias("reasons"), F.col("rank").cast("bigint").alias("rank"))


@register(
    "change_signals",
    f"""{C}, s AS (SELECT hash AS change_id, list_sort(files) AS f, CASE WHEN hash[-1] IN ('0', '5') THEN ['test_' || repo, 'a_' || repo] ELSE [] END AS t, CASE WHEN hash[-1] = '7' THEN [subject] ELSE [] END AS e FROM commits)
SELECT change_id, 'delta.scope.changed' AS signal, array_to_string(f, ', ') AS detail, 1.0::DOUBLE AS weight FROM s WHERE len(f) > 0
UNION ALL SELECT change_id, 'delta.dependency.changed', 'dependency-related files changed', 1.2 FROM s WHERE len(list_filter(f, lambda p: {file_class_sql('p')} = 'dependency')) > 0
UNION ALL SELECT change_id, 'delta.test.failure.introduced', array_to_string(list_sort(t), ', '), 1.2 FROM s WHERE len(t) > 0
UNION ALL SELECT change_id, 'delta.error.new', e[1], 1.0 FROM s WHERE len(e) > 0""",
)
def change_signals(spark, sf):
    c = demo.commits(spark, sf)
    end = F.substring("hash", -1, 1)
    none = F.array().cast("array<string>")
    d = c.select(
        F.col("hash").alias("change_id"), "files",
        F.when(end.isin("0", "5"), F.array(F.concat(F.lit("test_"), "repo"), F.concat(F.lit("a_"), "repo"))).otherwise(none).alias("tests_newly_failing"),
        F.when(end == "7", F.array("subject")).otherwise(none).alias("errors_added"),
    )
    return ch.change_signals(d)


@register(
    "merged_contexts",
    f"""{C}, a AS (SELECT repo, strftime(ts, '%Y-%m') AS m, list(DISTINCT file) AS fl FROM cf WHERE hash[-1] IN ('0', '1', '2', '3', '4', '5', '6', '7', '8', '9') GROUP BY 1, 2), b AS (SELECT repo, strftime(ts, '%Y-%m') AS m, list(DISTINCT file) AS fl FROM cf WHERE hash[-1] IN ('5', '6', '7', '8', '9', 'a', 'b', 'c', 'd', 'e', 'f') GROUP BY 1, 2),
 j AS (SELECT coalesce(a.repo, b.repo) || ':' || coalesce(a.m, b.m) AS change_id, a.fl AS fa, b.fl AS fb FROM a FULL JOIN b ON a.repo = b.repo AND a.m = b.m)
SELECT change_id, CASE WHEN fa IS NOT NULL THEN 'root-a' ELSE 'root-b' END AS root, CASE WHEN fb IS NOT NULL THEN 'ci' ELSE '' END AS provider,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(fa, []), coalesce(fb, [])))), '|') AS changed_files,
 CASE WHEN fa IS NOT NULL AND fb IS NOT NULL THEN 'k=b,x=a,y=b' WHEN fa IS NOT NULL THEN 'k=a,x=a' ELSE 'k=b,y=b' END AS env FROM j""",
)
def merged_contexts(spark, sf):
    c = demo.commits(spark, sf).withColumn("change_id", F.concat("repo", F.lit(":"), F.date_format("ts", "yyyy-MM")))
    end = F.substring("hash", -1, 1)

    def side(ends, root, provider, env):
        d = c.filter(end.isin(*ends)).select("change_id", F.explode("files").alias("f")).groupBy("change_id").agg(F.array_sort(F.collect_set("f")).alias("changed_files"))
        return d.withColumns({"root": F.lit(root), "provider": F.lit(provider), "env_diff": F.create_map(*[F.lit(x) for kv in env.items() for x in kv])})

    m = ch.merge_contexts(side("0123456789", "root-a", "", {"k": "a", "x": "a"}), side("56789abcdef", "root-b", "ci", {"k": "b", "y": "b"}), lists=["changed_files"])
    env = F.array_join(F.transform(F.array_sort(F.map_entries("env_diff")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return m.select("change_id", "root", "provider", F.array_join("changed_files", "|").alias("changed_files"), env.alias("env"))


JOBS = """SELECT user_id AS run_id, event_id AS job_id, concat('Job', event_id % 5) AS name, concat('stage', event_id % 3) AS stage, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'success' ELSE 'failed' END AS status FROM events"""


@register(
    "baseline_jobs",
    f"""WITH j AS ({JOBS}), c AS (SELECT DISTINCT user_id AS run_id, concat('job', user_id % 7) AS n, concat('Stage', user_id % 3) AS s FROM events),
 f AS (SELECT j.*, lower(j.name) = c.n AS bn FROM j JOIN c USING (run_id) WHERE status = 'success' AND (lower(j.name) = c.n OR lower(j.stage) = lower(c.s)))
SELECT run_id, job_id, name, stage FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY bn DESC, job_id DESC) = 1""",
)
def baseline_jobs(spark, sf):
    demo.events(spark, sf).createOrReplaceTempView("job_events")
    jobs = spark.sql(JOBS.replace("FROM events", "FROM job_events"))
    cur = jobs.select("run_id").distinct().select("run_id", F.concat(F.lit("job"), F.col("run_id") % 7).alias("name"), F.concat(F.lit("Stage"), F.col("run_id") % 3).alias("stage"))
    return ch.baseline_job(jobs, cur).select("run_id", "job_id", "name", "stage")


@register("scoped_changes", f"WITH {FILES_SQL} SELECT p_partkey, substr(path, 5) AS file FROM files WHERE starts_with(path, 'src/')")
def scoped_changes(spark, sf):
    return ch.scoped_changes(demo.files(spark, sf).withColumnRenamed("path", "file"), "src/").select("p_partkey", "file")
