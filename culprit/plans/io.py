"""Queries on readers, writers, page text and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from culprit.functions import html as ht
from culprit.functions import signature as sg
from culprit.functions import text as tx
from culprit.functions.storage import checkpoint_dir
from culprit.operators import corpus as cp
from culprit.operators import match as mt
from culprit.operators import rules as ru
from culprit.plans import demo, sql
from culprit.plans.sql import any_of, lit, sub
from culprit.plans.texts import CLUSTER, evidence_line_sql
from culprit.sources import corpus as sc
from culprit.sources import files as ff
from culprit.sources import history as sh
from culprit.sources import repository as rp
from culprit.streaming import jobs

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def scratch(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _page_sql():
    h = "regexp_replace(trim(html), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')"
    h = f"replace({h}, 'var t=\"</p>\"', 'var t=\"' || chr(1) || '/p>\"')"
    h = sub(h, "<!--.*?-->", " ")
    h = sub(h, "<!DOCTYPE[^>]*>", "")
    h = sub(h, f"(?i)</?(?:{'|'.join(ht.BLOCK_TAGS)}|pre)(?:\\s[^>]*)?/?>|<br(?:\\s[^>]*)?/?>", "\x02")
    h = sub(h, "</?[a-zA-Z][^>]*>", " ")
    for _ in range(2):
        for e, c in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
            h = f"replace({h}, '{e}', {lit(c)})"
    h = sub(sub(h, " +", " "), " ?\x02[ \x02]*", "\x02")
    return f"replace(replace(trim({h}, ' ' || chr(2)), chr(2), chr(10)), chr(1), '<')"


@register("page_texts", f"SELECT page_id, {_page_sql()} AS text FROM pages")
def page_texts(spark, sf):
    pages = demo.spread(demo.table(spark, sf, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", ht.html_to_text("html").alias("text"))


ISSUE = "CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN '```log' || chr(10) || text || chr(10) || '```' WHEN turn % 2 = 0 THEN text ELSE replace(text, '. ', chr(10) || chr(10)) || ' failed' END"
CANON_BLOCK = f"array_to_string({sql.lines('b')}, chr(10))"
LOOKS = f"({any_of('lower(b)', ht.ERROR_SIGNALS)} OR len(string_split(b, chr(10))) >= 6)"


@register(
    "log_snippets",
    f"""WITH i AS (SELECT conv_id, string_agg({ISSUE}, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1),
 f AS (SELECT conv_id, t, list_filter(list_transform(regexp_extract_all(t, '(?s)```[^\\n`]*\\n(.*?)```', 1), lambda b: {CANON_BLOCK}), lambda b: {LOOKS}) AS fb,
   list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda b: {CANON_BLOCK}), lambda b: {LOOKS}) AS pb FROM i),
 s AS (SELECT conv_id, CASE WHEN len(fb) > 0 THEN fb ELSE pb END AS ss FROM f), d AS (SELECT conv_id, list_filter(ss, lambda x, i: NOT list_contains(ss[1:i - 1], x)) AS ss FROM s),
 e AS (SELECT conv_id, unnest(ss) AS snippet, generate_subscripts(ss, 1) AS n FROM d)
SELECT conv_id, n, snippet, 'forum-team-repo-' || conv_id % 3 || '-' || conv_id || '-s' || n || '-' || left(sha256(snippet), 16) AS snippet_id FROM e""",
)
def log_snippets(spark, sf):
    c = demo.table(spark, sf, "conversations").select("conv_id", "turn", F.expr(ISSUE.replace("chr(10)", "char(10)")).alias("t"))
    issue = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n")
    s = issue.select("conv_id", text.alias("t")).select("conv_id", F.posexplode(ht.log_snippets(F.col("t"))).alias("pos", "snippet"))
    repo = F.concat(F.lit("Team/Repo "), F.col("conv_id") % 3)
    return s.select("conv_id", (F.col("pos") + 1).cast("bigint").alias("n"), "snippet",
                    ht.snippet_id(F.lit("forum"), repo, F.col("conv_id"), F.col("pos") + 1, F.col("snippet")).alias("snippet_id"))


@register(
    "run_parts",
    "SELECT conv_id AS run_id, string_agg(CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END, chr(10) ORDER BY lpad(turn::VARCHAR, 4, '0') || role) AS text FROM conversations GROUP BY 1",
)
def run_parts(spark, sf):
    p = demo.table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"), F.concat(F.lpad(F.col("turn").cast("string"), 4, "0"), "role").alias("name"), F.col("text").alias("body"))
    return rp.join_run_parts(p)


@register(
    "corpus_csv_roundtrip",
    "SELECT doc_id::VARCHAR AS id, replace(text, chr(10), ' ') AS raw, source AS ts, lang, n_chars::VARCHAR AS n_chars FROM documents",
)
def corpus_csv_roundtrip(spark, sf):
    path = scratch(spark, "csv")
    demo.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("ts"), F.col("text").alias("message"), "lang", "n_chars").write.csv(
        path, header=True, escape='"', quoteAll=True, lineSep="\n")
    r = sc.read_corpus_csv(spark, path, "message", "id", "ts")
    return r.select("id", "raw", F.col("timestamp").alias("ts"), F.col("fields")["lang"].alias("lang"), F.col("fields")["n_chars"].alias("n_chars"))


@register("corpus_csv_numbers", "SELECT doc_id::VARCHAR AS id, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS line_num FROM documents")
def corpus_csv_numbers(spark, sf):
    """Files of 500 documents: their number grows with the table, not their size."""
    path = scratch(spark, "csv")
    docs = demo.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 500).alias("part"), F.col("doc_id").alias("id"), F.col("text").alias("message"))
    docs.repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").csv(path, header=True, escape='"', quoteAll=True)
    return sc.read_corpus_csv(spark, path, "message", "id").select("id", "line_num")


@register("results_json_roundtrip", sql.results() + "SELECT log_id::VARCHAR AS fixture_id, matched, failure_id, confidence, coalesce(array_to_string(evidence, '|'), '') AS evidence FROM results")
def results_json_roundtrip(spark, sf):
    path = scratch(spark, "json")
    r = mt.evaluate_logs(demo.logs(spark, sf), demo.rules(spark), source="source")
    sc.write_json_table(r.withColumn("fixture_id", F.col("log_id").cast("string")).drop("log_id"), path)
    d = sc.read_json_table(spark, path, sc.RESULT_SCHEMA)
    return d.select("fixture_id", "matched", "failure_id", "confidence", F.array_join("evidence", "|").alias("evidence"))


@register("history_lines", "SELECT count(*) AS n, sum((event_type <> 'view')::INT)::BIGINT AS n_matched FROM events WHERE event_id % 10 <> 0")
def history_lines(spark, sf):
    """Every tenth line is broken on purpose and must be skipped."""
    path = scratch(spark, "history")
    good = F.to_json(F.struct((F.col("event_type") != "view").alias("matched"), F.col("event_type").alias("failure_id")))
    demo.table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit('{"matched": tru')).otherwise(good)).write.text(path)
    h = sc.read_history_lines(spark, path)
    return h.agg(F.count("*").alias("n"), F.sum(F.col("matched").cast("bigint")).alias("n_matched"))


@register(
    "commit_log",
    demo.COMMITS_SQL.join(["WITH ", " SELECT repo, hash, strftime(ts, '%Y-%m-%d') AS date, subject, author, array_to_string(files, '|') AS files FROM commits"]),
)
def commit_log(spark, sf):
    """Commits written as exported log text and read back."""
    path = scratch(spark, "log")
    c = demo.commits(spark, sf)
    e = rp.FIELD_SEPARATOR
    block = F.concat(F.concat_ws(e, F.concat_ws("@", "repo", "hash"), F.unix_timestamp("ts").cast("string"), "subject", "author"), F.lit("\n"), F.array_join("files", "\n"), F.lit("\n\n"))
    c.select(block).write.option("lineSep", rp.RECORD_SEPARATOR).text(path)
    r = rp.read_commit_log(spark, path)
    return r.select(F.substring_index("hash", "@", 1).alias("repo"), F.substring_index("hash", "@", -1).alias("hash"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
                    "subject", "author", F.array_join("files", "|").alias("files"))


DIFF = """'diff --git a/' || path || ' b/' || path || chr(10) || '--- a/' || path || chr(10) || '+++ ' || CASE WHEN p_size % 9 = 0 THEN '/dev/null' ELSE 'b/' || path END || chr(10) ||
 '@@ -1 +' || (p_size + 1) || ' @@ x' || chr(10) || '+a' || chr(10) || '@@ -5,2 +' || (p_size + 10) || ',' || p_size % 4 || ' @@' || chr(10) || '+b'"""


@register(
    "diff_lines",
    f"""WITH f AS (SELECT p_partkey, p_size, {demo.FILE_PATH} AS path FROM part WHERE p_size % 9 <> 0)
SELECT DISTINCT p_partkey // 40 AS repo, path AS file, (p_size + 1)::BIGINT AS line FROM f UNION SELECT p_partkey // 40, path, (p_size + 10 + unnest(range(0, p_size % 4)))::BIGINT FROM f""",
)
def diff_lines(spark, sf):
    f = demo.table(spark, sf, "part").select("p_partkey", "p_size", F.expr(demo.FILE_PATH).alias("path"))
    f = f.select(F.floor(F.col("p_partkey") / 40).alias("repo"), "p_partkey", F.expr(DIFF.replace("chr(10)", "char(10)")).alias("d"))
    diffs = f.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "d"))), lambda x: x["d"]), "\n").alias("diff"))
    return rp.diff_lines(diffs)


STATUS = "CASE p_partkey % 6 WHEN 0 THEN ' M ' || path WHEN 1 THEN '?? ' || path WHEN 2 THEN 'A  ' || path WHEN 3 THEN ' D ' || path WHEN 4 THEN 'R  old/' || path || ' -> ' || path ELSE '' END"


@register(
    "status_files",
    f"WITH f AS (SELECT p_partkey, {demo.FILE_PATH} AS path FROM part) SELECT p_partkey, path AS file, CASE WHEN p_partkey % 6 IN (1, 2) THEN 'added' WHEN p_partkey % 6 = 3 THEN 'deleted' ELSE 'modified' END AS status FROM f WHERE p_partkey % 6 < 5",
)
def status_files(spark, sf):
    return rp.status_files(demo.files(spark, sf).select("p_partkey", F.expr(STATUS).alias("line")))


@register(
    "owner_files",
    """SELECT s_suppkey // 30 AS repo, row_number() OVER (PARTITION BY s_suppkey // 30 ORDER BY s_suppkey) * 2 - 2 AS idx, '/dir' || s_suppkey || '/' AS pattern, '@team' || s_suppkey % 5 || '|@lead' AS owners FROM supplier QUALIFY s_suppkey % 3 <> 0""",
)
def owner_files(spark, sf):
    line = F.when(F.col("s_suppkey") % 3 == 0, F.lit("only-pattern")).otherwise(F.format_string("/dir%d/\t@team%d  @lead ", F.col("s_suppkey"), F.col("s_suppkey") % 5))
    t = demo.table(spark, sf, "supplier").groupBy(F.floor(F.col("s_suppkey") / 30).alias("repo")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("l")))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["l"]), "\n# comment\n")
    o = rp.owner_rules(t.select("repo", text.alias("text")))
    return o.select("repo", F.col("idx").cast("bigint").alias("idx"), "pattern", F.array_join("owners", "|").alias("owners"))


@register(
    "source_tree",
    f"WITH {demo.FILES_SQL}, t AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'vendor/' || path WHEN 1 THEN 'a/node_modules/' || path ELSE path END AS path FROM files) SELECT p_partkey, path FROM t "
    "WHERE p_partkey % 9 > 1 AND regexp_matches(lower(path), '\\.(go|js|jsx|ts|tsx|py|java|rb|php|cs|kt|yaml|yml)$')",
)
def source_tree(spark, sf):
    p = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("vendor/"), "path")).when(F.col("p_partkey") % 9 == 1, F.concat(F.lit("a/node_modules/"), "path")).otherwise(F.col("path"))
    return demo.files(spark, sf).select("p_partkey", p.alias("path")).filter(rp.is_source_path(F.col("path")))


@register("source_tree_files", """SELECT p_partkey // 10 AS folder, string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS content FROM part GROUP BY 1""")
def source_tree_files(spark, sf):
    """A tree on disk with one small file for ten parts, and the same files again under a skipped folder."""
    root = scratch(spark, "tree")
    part = demo.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("folder"), "p_partkey", "p_name")
    for top in ("src", "vendor"):
        ff.write_lines(part, f"{root}/{top}", "folder", "p_name", ["p_partkey"], "php")
    files = rp.read_source_tree(spark, root, "r")
    return files.select(F.regexp_extract("path", "^src/folder=([0-9]+)/", 1).cast("bigint").alias("folder"), "content")


@register(
    "appended_history",
    sql.ranked(rules=demo.CI_RULES, source="event_logs") + f"""SELECT log_id AS run_id, rank, rule_id AS failure_id, confidence, sha256('{{"version":"{sg.VERSION}","failure_id":"' || rule_id || '","detector":"log","evidence":' ||
 to_json(list_sort(list_distinct(list_filter(list_transform(evidence, lambda line: {evidence_line_sql('line')}), lambda l: l <> ''))))::VARCHAR || '}}') AS signature_hash FROM ranked""",
)
def appended_history(spark, sf):
    """Diagnosed logs appended to the history tables, findings read back."""
    root = scratch(spark, "store")
    d = mt.diagnose(demo.event_logs(spark, sf), demo.ci_rules(spark))
    day = F.to_timestamp(F.regexp_extract("log_id", r"-(\d{4}-\d{2}-\d{2})$", 1))
    sh.append_history(sh.history_rows(d, day), root)
    f = sh.read_history(spark, root, "findings")
    return f.select("run_id", F.col("rank").cast("bigint").alias("rank"), "failure_id", "confidence", "signature_hash")


def _appended(spark, sf, name, hooks=None):
    """One history table, written by day and read back."""
    root = scratch(spark, "store")
    d = mt.diagnose(demo.event_logs(spark, sf), demo.ci_rules(spark))
    day = F.to_timestamp(F.regexp_extract("log_id", r"-(\d{4}-\d{2}-\d{2})$", 1))
    rows = sh.history_rows(d, day, hooks=hooks(d) if hooks else None)
    sh.append_history({name: rows[name]}, root)
    return sh.read_history(spark, root, name)


CI = {"rules": demo.CI_RULES, "source": "event_logs"}


@register("appended_runs", sql.ranked(**CI) + "SELECT l.log_id AS run_id, r.rule_id IS NOT NULL AS matched, r.rule_id AS failure_id FROM event_logs l LEFT JOIN ranked r ON r.log_id = l.log_id AND r.rank = 1")
def appended_runs(spark, sf):
    return _appended(spark, sf, "runs").select("run_id", "matched", "failure_id")


@register("appended_matches", sql.ranked(**CI) + "SELECT log_id AS run_id, rank, rule_id, score, confidence FROM ranked")
def appended_matches(spark, sf):
    return _appended(spark, sf, "matches").select("run_id", F.col("rank").cast("bigint").alias("rank"), "rule_id", "score", "confidence")


@register(
    "appended_hooks",
    sql.ranked(**CI) + f"""SELECT log_id AS run_id, rule_id, 'hook-' || rank AS hook_id, CASE WHEN rank = 1 THEN 'verify' ELSE 'collect' END AS category, CASE WHEN rank % 2 = 1 THEN 'executed' ELSE 'failed' END AS status,
 rank % 2 = 1 AS passed, rank / 100.0E0 AS confidence_delta, sha256('{{"version":"{sg.VERSION}","failure_id":"' || rule_id || '","detector":"log","evidence":' ||
 to_json(list_sort(list_distinct(list_filter(list_transform(evidence, lambda line: {evidence_line_sql('line')}), lambda l: l <> ''))))::VARCHAR || '}}') AS signature_hash FROM ranked""",
)
def appended_hooks(spark, sf):
    def hooks(d):
        rank = F.col("rank")
        return d.filter("live").select(
            "log_id", "rule_id", F.concat(F.lit("hook-"), rank).alias("hook_id"), F.when(rank == 1, "verify").otherwise("collect").alias("category"), F.lit("command").alias("kind"),
            F.when(rank % 2 == 1, "executed").otherwise("failed").alias("status"), (rank % 2 == 1).alias("passed"), (rank / 100.0).alias("confidence_delta"), F.lit("").alias("reason"),
        )

    return _appended(spark, sf, "hooks", hooks).select("run_id", "rule_id", "hook_id", "category", "status", "passed", "confidence_delta", "signature_hash")


@register(
    "cluster_samples",
    sql.results(demo.CI_RULES[:2], "event_logs").rstrip() + """, u AS (SELECT log_id, first_line_snippet AS line FROM results WHERE NOT matched AND error = ''),
 v AS (SELECT log_id, CLUSTERX AS c FROM u), w AS (SELECT *, left(sha256(c), 8) AS sig FROM v), g AS (SELECT sig, count(*) AS n, list_sort(list(log_id))[1:5] AS ids FROM w GROUP BY 1),
 k AS (SELECT *, format('cluster-{:03d}', row_number() OVER (ORDER BY n DESC, sig)) AS cluster_id FROM g), e AS (SELECT cluster_id, unnest(ids) AS log_id FROM k)
SELECT cluster_id, log_id, text FROM e JOIN event_logs USING (log_id)""".replace("CLUSTERX", CLUSTER),
)
def cluster_samples(spark, sf):
    from culprit.operators.rules import RuleSet

    logs = demo.event_logs(spark, sf)
    c = cp.gap_clusters(mt.evaluate_logs(logs, RuleSet.from_records(spark, demo.CI_RULES[:2])))
    s = sc.cluster_samples(c, logs.withColumn("both", F.concat_ws("\u0001", "log_id", "text")), text="both")
    return s.select("cluster_id", F.substring_index("value", "\u0001", 1).alias("log_id"), F.substring_index("value", "\u0001", -1).alias("text"))


@register("cluster_sample_files", ORACLES["cluster_samples"].replace("SELECT cluster_id, log_id, text FROM e", "SELECT cluster_id, unnest(string_split(text, chr(10))) AS line FROM e"))
def cluster_sample_files(spark, sf):
    """Sample logs of the clusters as text files, one folder for each cluster, read back line by line."""
    from culprit.operators.rules import RuleSet

    logs, path = demo.event_logs(spark, sf), scratch(spark, "samples")
    c = cp.gap_clusters(mt.evaluate_logs(logs, RuleSet.from_records(spark, demo.CI_RULES[:2])))
    sc.write_cluster_samples(c, logs, path, text="text")
    return sc.read_cluster_samples(spark, path).select("cluster_id", F.col("value").alias("line"))


# Streams over the same tables; append mode shows what the watermark has closed.
def _event_stream(spark, sf):
    schema = demo.table(spark, sf, "events").schema
    s = jobs.table_stream(spark, f"{sf}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return s.select("event_id", "ts", "user_id", "event_type", (F.col("event_type") != "view").alias("matched"), F.col("event_type").alias("failure_id"))


CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def _fmt(*names):
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


@register(
    "stream_windows",
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n, sum((event_type <> 'view')::INT)::BIGINT AS m FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS failure_id, n, m AS n_matched FROM w WHERE s + INTERVAL 1 HOUR <= {CLOSED}""",
)
def stream_windows(spark, sf):
    s = jobs.windowed_counts(_event_stream(spark, sf))
    out = jobs.drain_to_table(s, scratch(spark, "win"), scratch(spark, "cp"))
    return out.select(*_fmt("window_start"), "failure_id", "n", "n_matched")


@register(
    "stream_sliding_windows",
    f"""WITH x AS (SELECT ts, event_type, unnest([0, 1]) AS k FROM events), w AS (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS s, event_type, count(*) AS n FROM x GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS failure_id, n FROM w WHERE s + INTERVAL 2 HOUR <= {CLOSED}""",
)
def stream_sliding_windows(spark, sf):
    s = jobs.windowed_counts(_event_stream(spark, sf), length="2 hours", slide="1 hour")
    return jobs.drain_to_table(s, scratch(spark, "win"), scratch(spark, "cp")).select(*_fmt("window_start"), "failure_id", "n")


@register(
    "stream_sessions",
    f"""WITH f AS (SELECT date_trunc('millisecond', ts) AS ts0, ts, concat(event_type, '-', user_id % 5) AS sig FROM events WHERE event_type <> 'view'),
 g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM f WINDOW w AS (PARTITION BY sig ORDER BY ts)),
 h AS (SELECT *, sum(brk) OVER (PARTITION BY sig ORDER BY ts) AS k FROM g), s AS (SELECT sig, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM h GROUP BY 1, 2)
SELECT sig AS signature_hash, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, n FROM s WHERE b + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM f)""",
)
def stream_sessions(spark, sf):
    f = _event_stream(spark, sf).filter("matched").select(F.col("ts").alias("seen_at"), F.concat_ws("-", "event_type", (F.col("user_id") % 5).cast("string")).alias("signature_hash"))
    out = jobs.drain_to_table(jobs.failure_sessions(f), scratch(spark, "ses"), scratch(spark, "cp"))
    return out.select("signature_hash", *_fmt("session_start"), "n")


@register(
    "stream_recurrence",
    """SELECT concat(event_type, '-', user_id % 20) AS signature_hash, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen_at, count(*) AS occurrence_count
FROM events WHERE event_type <> 'view' GROUP BY 1""",
)
def stream_recurrence(spark, sf):
    """The events split into several files, so state is updated over several batches."""
    parts = scratch(spark, "parts")
    demo.events(spark, sf).repartition(3, "event_id").write.parquet(parts)
    s = jobs.file_stream(spark, parts, spark.read.parquet(parts).schema)
    f = s.filter("event_type <> 'view'").select(F.lit(1).alias("rank"), F.col("ts").alias("seen_at"), F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string")).alias("signature_hash"))
    table = scratch(spark, "rec")
    jobs.run_available(jobs.recurrence_stream(f).writeStream.outputMode("update").foreachBatch(jobs.upsert_versions(table)), scratch(spark, "cp"))
    return jobs.latest_versions(spark, table).select("signature_hash", *_fmt("first_seen_at", "last_seen_at"), "occurrence_count")


@register("stream_dedupe", f"SELECT sha256({sql.trim_space('text')}) AS fixture_id FROM documents GROUP BY 1")
def stream_dedupe(spark, sf):
    """The corpus as a stream; all logs carry the same time, so no id expires."""
    schema = demo.table(spark, sf, "documents").schema
    s = jobs.table_stream(spark, f"{sf}/documents.parquet", schema, 32).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    out = jobs.drain_to_table(jobs.dedupe_stream(s).select("fixture_id", "ts"), scratch(spark, "ded"), scratch(spark, "cp"))
    return out.select("fixture_id")


@register("stream_evaluate", sql.results() + "SELECT log_id, matched, failure_id, confidence FROM results")
def stream_evaluate(spark, sf):
    schema = demo.table(spark, sf, "documents").schema
    s = jobs.table_stream(spark, f"{sf}/documents.parquet", schema, 32).select(F.col("doc_id").alias("log_id"), "text", "source")
    out = scratch(spark, "eval")
    writer = jobs.evaluate_stream(s, demo.rules(spark), lambda r, i: r.write.mode("overwrite").parquet(f"{out}/batch={i}"), source="source")
    jobs.run_available(writer, scratch(spark, "cp"))
    return spark.read.parquet(out).select("log_id", "matched", "failure_id", "confidence")


@register("input_hashes", f"SELECT doc_id AS log_id, sha256(array_to_string({sql.lines('text')}, chr(10))) AS input_hash FROM documents")
def input_hashes(spark, sf):
    return sc.input_hashes(demo.logs(spark, sf))


@register(
    "match_fingerprints",
    sql.ranked() + """SELECT log_id, rule_id, format('{:08x}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(fp) + 1), lambda i: ('0x' || hex(encode(fp)[i:i]))::BIGINT)),
 lambda a, b: (xor(a, b) * 16777619) & 4294967295)) AS fingerprint FROM (SELECT log_id, rule_id, rule_id || array_to_string(evidence[1:3], '') AS fp FROM ranked)""",
)
def match_fingerprints(spark, sf):
    r = mt.match_rules(demo.logs(spark, sf), demo.rules(spark))
    return r.select("log_id", "rule_id", mt.match_fingerprint(F.col("rule_id"), F.col("evidence")).alias("fingerprint"))


@register("log_files", "SELECT doc_id AS log_id, text || chr(10) AS text FROM documents")
def log_files(spark, sf):
    """Each document as a log file of its own, read back with its path as source."""
    path = scratch(spark, "logs")
    ff.write_lines(demo.table(spark, sf, "documents"), path, "doc_id", "text")
    name = F.regexp_extract("source", "doc_id=(-?[0-9]+)/[^/]*$", 1).cast("bigint")
    return sc.read_logs(spark, path).select(name.alias("log_id"), "text")


@register(
    "fixture_files",
    f"""WITH g AS (SELECT doc_id, array_to_string({sql.lines('text')}, chr(10)) AS t FROM documents)
SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'real' ELSE 'minimal' END AS fixture_class, left(sha256(t), 16) AS fingerprint, 'rule-' || doc_id % 5 AS expected FROM g""",
)
def fixture_files(spark, sf):
    """Labelled fixtures as JSON lines and back."""
    path = scratch(spark, "fixtures")
    d = demo.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, "real").alias("fixture_class"), F.col("text").alias("raw_log"), F.lit("").alias("normalized_log"),
        F.struct(F.concat(F.lit("rule-"), F.col("doc_id") % 5).alias("expected_playbook"), F.lit(1).alias("top_n")).alias("expectation"), F.lit("").alias("fingerprint"),
    )
    sc.write_json_table(d, path)
    return sc.read_fixtures(spark, path).select("id", "fixture_class", "fingerprint", F.col("expectation.expected_playbook").alias("expected"))


def _loaded(spark):
    """The rule tables, written and loaded again with their checks."""
    rules, path = demo.rules(spark), scratch(spark, "rules")
    rules.rules.write.parquet(f"{path}/rules")
    rules.patterns.write.parquet(f"{path}/patterns")
    return ru.load_rules(spark.read.parquet(f"{path}/rules"), spark.read.parquet(f"{path}/patterns"))


@register("evaluate_loaded_rules", sql.results() + "SELECT log_id, matched, failure_id, confidence FROM results")
def evaluate_loaded_rules(spark, sf):
    return mt.evaluate_logs(demo.logs(spark, sf), _loaded(spark), source="source").select("log_id", "matched", "failure_id", "confidence")


@register("explained_logs", sql.results() + "SELECT x.log_id, r.rule_id, r.title, r.category, r.severity FROM results x JOIN rules r ON r.rule_id = x.failure_id WHERE x.matched AND r.rule_id = 'stutter'")
def explained_logs(spark, sf):
    """Logs of one rule with what the rule says."""
    rule = demo.rules(spark).explain("stutter").select("rule_id", "title", "category", "severity")
    r = mt.evaluate_logs(demo.logs(spark, sf), demo.rules(spark), source="source").filter("matched")
    return r.select("log_id", F.col("failure_id").alias("rule_id")).join(rule, "rule_id")


@register(
    "unknown_fingerprints",
    """WITH l AS (SELECT doc_id, 'unknown' || lang || source || 'step' || array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], lambda x: trim(x)), '') AS fp FROM documents)
SELECT doc_id AS log_id, format('{:08x}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(fp) + 1), lambda i: ('0x' || hex(encode(fp)[i:i]))::BIGINT)),
 lambda a, b: (xor(a, b) * 16777619) & 4294967295)) AS fingerprint FROM l""",
)
def unknown_fingerprints(spark, sf):
    d = demo.logs(spark, sf).join(demo.table(spark, sf, "documents").select(F.col("doc_id").alias("log_id"), "lang"), "log_id")
    signals = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return d.select("log_id", mt.unknown_fingerprint(F.col("lang"), F.col("source"), F.lit("step"), signals).alias("fingerprint"))
