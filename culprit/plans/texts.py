"""Queries on the text functions: normalisation, masks, hashes, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from culprit.functions import classify as cl
from culprit.functions import paths as pt
from culprit.functions import signature as sg
from culprit.functions import stage as st
from culprit.functions import text as tx
from culprit.plans import demo
from culprit.plans import sql
from culprit.plans.demo import EVENT_LOGS_SQL
from culprit.plans.sql import any_of, chain, clean, collapse, lit, sub, trim_space

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


EV = f"WITH {EVENT_LOGS_SQL}"


@register(
    "canonicalize_documents",
    f"SELECT doc_id, array_to_string({sql.lines('text')}, chr(10)) AS canonical, "
    f"sha256(array_to_string({sql.lines('text')}, chr(10))) AS input_hash FROM documents",
)
def canonicalize_documents(spark, sf):
    d = demo.logs(spark, sf).withColumn("canonical", tx.canonicalize_log(F.col("text")))
    return d.select(F.col("log_id").alias("doc_id"), "canonical", F.sha2("canonical", 256).alias("input_hash"))


@register(
    "canonicalize_event_logs",
    f"{EV} SELECT log_id, array_to_string({sql.lines('text')}, chr(10)) AS canonical FROM event_logs",
)
def canonicalize_event_logs(spark, sf):
    return demo.event_logs(spark, sf).select("log_id", tx.canonicalize_log(F.col("text")).alias("canonical"))


@register("normalize_lines", f"{EV} SELECT event_id, {clean('line')} AS clean, lower({clean('line')}) AS norm FROM event_lines")
def normalize_lines(spark, sf):
    c = F.col("line")
    return demo.event_lines(spark, sf).select("event_id", tx.clean_line(c).alias("clean"), tx.normalize_line(c).alias("norm"))


@register(
    "normalize_patterns",
    f"SELECT item_id, lower({collapse('text')}) AS norm FROM benchmark",
)
def normalize_patterns(spark, sf):
    return demo.table(spark, sf, "benchmark").select("item_id", tx.normalize_pattern(F.col("text")).alias("norm"))


REDACT = [(tx.EMAIL, "<email>")] + [(t, "<token>") for t in tx.TOKENS]


@register(
    "redact_documents",
    f"SELECT doc_id, {chain('text', REDACT)} AS redacted, {chain('text', REDACT[:1])} AS emails_only FROM documents",
)
def redact_documents(spark, sf):
    c = F.col("text")
    return demo.logs(spark, sf).select(
        F.col("log_id").alias("doc_id"), tx.redact(c).alias("redacted"), tx.redact(c, tokens=False).alias("emails_only")
    )


SANITIZE = [(p, r) for _, p, r in tx.SANITIZERS]


@register("sanitize_event_lines", f"{EV} SELECT event_id, {chain('line', SANITIZE)} AS sanitized FROM event_lines")
def sanitize_event_lines(spark, sf):
    return demo.event_lines(spark, sf).select("event_id", tx.sanitize(F.col("line")).alias("sanitized"))


def _audit_sql():
    parts, text = [], "text"
    for name, p, r in tx.SANITIZERS:
        parts.append(f"SELECT doc_id AS log_id, '{name}' AS rule, len(regexp_extract_all({text}, {lit(p)}))::BIGINT AS n FROM documents")
        text = sub(text, p, r)
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0"


@register("sanitize_audit", _audit_sql())
def sanitize_audit(spark, sf):
    return tx.sanitize_rows(demo.logs(spark, sf).select("log_id", "text"))


@register(
    "sanitize_totals",
    f"SELECT rule, count(*) AS logs, sum(n)::BIGINT AS total FROM ({_audit_sql()}) GROUP BY rule",
)
def sanitize_totals(spark, sf):
    return sanitize_audit(spark, sf).groupBy("rule").agg(F.count("*").alias("logs"), F.sum("n").alias("total"))


def _prefix_sql(expr, n):
    ok = [f"hex(encode({expr})[{i}:{i}]) NOT BETWEEN '80' AND 'BF'" for i in (n + 1, n, n - 1)]
    return (
        f"CASE WHEN strlen({expr}) <= {n} THEN {expr} ELSE decode(encode({expr})[1:CASE WHEN {ok[0]} THEN {n} "
        f"WHEN {ok[1]} THEN {n - 1} WHEN {ok[2]} THEN {n - 2} ELSE {n - 3} END]) END"
    )


@register(
    "cap_size",
    f"SELECT doc_id, CASE WHEN strlen(text) <= 1024 THEN text ELSE {_prefix_sql('text', 1024)} || {lit(tx.TRUNCATION_MARK)} END AS capped, "
    "strlen(text) AS n_bytes FROM documents".replace("\n...", "' || chr(10) || '..."),
)
def cap_size(spark, sf):
    return demo.table(spark, sf, "documents").select(
        "doc_id", tx.cap_size(F.col("text"), tx.parse_size("1kb")).alias("capped"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )


@register(
    "content_ids",
    f"SELECT doc_id, sha256({trim_space('text')}) AS content_id, left(sha256(text), 16) AS fingerprint FROM documents",
)
def content_ids(spark, sf):
    c = F.col("text")
    return demo.logs(spark, sf).select(
        F.col("log_id").alias("doc_id"), tx.content_id(c).alias("content_id"), tx.fixture_fingerprint(c).alias("fingerprint")
    )


FNV = (
    "format('{{:08x}}', list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen({e}) + 1), "
    "lambda i: ('0x' || hex(encode({e})[i:i]))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295))"
)


@register("fnv_hash", f"{EV} SELECT event_id, {FNV.format(e='line')} AS h FROM event_lines")
def fnv_hash(spark, sf):
    return demo.event_lines(spark, sf).select("event_id", tx.fnv1a32(F.col("line")).alias("h"))


FIRST = f"lower({trim_space('string_split(text, chr(10))[1]')})"


@register(
    "first_line_tags",
    f"WITH f AS (SELECT doc_id, {FIRST} AS l FROM documents), g AS (SELECT doc_id, {_prefix_sql('l', 120)} AS snippet FROM f) "
    "SELECT doc_id, snippet, CASE WHEN snippet = '' THEN '' ELSE left(sha256(snippet), 8) END AS tag FROM g",
)
def first_line_tags(spark, sf):
    c = F.col("text")
    return demo.table(spark, sf, "documents").select("doc_id", tx.first_line(c).alias("snippet"), tx.first_line_tag(c).alias("tag"))


CLUSTER = f"lower({trim_space(chain(trim_space('line'), tx.CLUSTER_MASKS))})"


def _gap_case(value):
    whens = ""
    for cls, w, a, b in cl.GAP_CLASSES:
        ma, mb = f"regexp_matches(c, {lit(a)})", f"regexp_matches(c, {lit(b)})"
        then = lit(cls) if value == "class" else f"CASE WHEN {ma} AND {mb} THEN {w} ELSE {w} * 0.5 END"
        whens += f" WHEN {ma} OR {mb} THEN {then}"
    return f"CASE{whens} ELSE {lit('unknown') if value == 'class' else '0.3'} END"


GAP_CLASS_SQL, GAP_CONF_SQL = _gap_case("class"), _gap_case("confidence")


@register(
    "cluster_lines",
    f"{EV}, c AS (SELECT event_id, {CLUSTER} AS c FROM event_lines) SELECT event_id, c AS clean, left(sha256(c), 8) AS signature, "
    f"{GAP_CLASS_SQL} AS suspected_class, ({GAP_CONF_SQL})::DOUBLE AS confidence FROM c",
)
def cluster_lines(spark, sf):
    d = demo.event_lines(spark, sf).select("event_id", tx.cluster_line(F.col("line")).alias("clean"))
    cls, conf = cl.gap_class(F.col("clean"))
    return d.select("event_id", "clean", tx.cluster_signature(F.col("clean")).alias("signature"), cls.alias("suspected_class"),
                    conf.alias("confidence"))


EDGE = r"[\"'()\[\]{}<>,;:]+"


def _path_sql(t):
    """Generalised path of token expression ``t``, written with list functions."""
    trimmed = f"regexp_replace({t}, {lit(f'^{EDGE}|{EDGE}$')}, '', 'g')"
    suffix = f"regexp_extract({trimmed}, '^.[^\\n]*?((?::[0-9]+)+)$', 1)"
    numbers = sub(suffix, ":[0-9]+", ":<n>")
    path = f"regexp_replace(replace(left({trimmed}, length({trimmed}) - length({suffix})), '\\', '/'), '/+$', '')"
    parts = f"list_filter(string_split(regexp_replace({path}, '^/+|/+$', '', 'g'), '/'), lambda p, i: NOT (i = 1 AND ends_with(p, ':')))"
    low = f"lower({path})"

    def tail(k):
        return f"array_to_string(({parts})[greatest(len({parts}) - {k - 1}, 1):], '/')"

    def out(label, k):
        return f"CASE WHEN {tail(k)} = '' THEN '{label}' ELSE '{label}/' || {tail(k)} END || {numbers}"

    whens = ""
    for label, roots, keep in pt.PATH_ROOTS:
        cond = " OR ".join(f"starts_with({low}, {lit(r)})" for r in roots)
        if label == "<tmp>":
            cond += f" OR (starts_with({low}, 'c:/users/') AND contains({low}, '/appdata/local/temp/'))"
        whens += f" WHEN {cond} THEN {out(label, keep)}"
    return (
        f"CASE{whens} WHEN starts_with({path}, '/') OR regexp_matches({path}, '^.:/') THEN {out('<path>', 3)} ELSE {path} || {numbers} END"
    )


def evidence_line_sql(c):
    c = trim_space(sub(c, tx.ANSI_ESCAPE, ""))
    c = chain(c, tx.SIGNATURE_MASKS_BEFORE_PATHS)
    trimmed = f"replace(regexp_replace(f, {lit(f'^{EDGE}|{EDGE}$')}, '', 'g'), '\\', '/')"
    looks = f"(starts_with({trimmed}, '/') OR regexp_matches({trimmed}, '^.:/'))"
    c = (
        f"array_to_string(list_transform(string_split({collapse(c)}, ' '), lambda f: CASE WHEN {looks} THEN {_path_sql('f')} ELSE f END), ' ')"
    )
    return f"lower({collapse(chain(c, tx.SIGNATURE_MASKS_AFTER_PATHS))})"


@register("signature_lines", f"{EV} SELECT event_id, {evidence_line_sql('line')} AS normalized FROM event_lines")
def signature_lines(spark, sf):
    return demo.event_lines(spark, sf).select("event_id", sg.normalize_evidence_line(F.col("line")).alias("normalized"))


@register(
    "generalize_paths",
    f"""WITH {demo.FILES_SQL}, t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/tmp/run' || p_partkey || '/' || path
 WHEN 1 THEN '/home/runner/work/' || path || ':12:3' WHEN 2 THEN '(/home/dev/' || path || ')' WHEN 3 THEN 'C:\\Users\\bob\\AppData\\Local\\Temp\\' || path
 WHEN 4 THEN '/srv/' || path || '/' ELSE path END AS token FROM files)
SELECT p_partkey, token, {_path_sql('token')} AS general FROM t""",
)
def generalize_paths(spark, sf):
    token = F.expr(
        """CASE p_partkey % 6 WHEN 0 THEN '/tmp/run' || p_partkey || '/' || path
 WHEN 1 THEN '/home/runner/work/' || path || ':12:3' WHEN 2 THEN '(/home/dev/' || path || ')'
 WHEN 3 THEN 'C:\\\\Users\\\\bob\\\\AppData\\\\Local\\\\Temp\\\\' || path
 WHEN 4 THEN '/srv/' || path || '/' ELSE path END"""
    )
    return demo.files(spark, sf).select("p_partkey", token.alias("token")).select(
        "p_partkey", "token", pt.generalize_path(F.col("token")).alias("general")
    )


STAGE_SQL = sql.line_stage("lower(line)")


@register(
    "line_stages",
    f"{EV}, c AS (SELECT event_id, {clean('line')} AS line FROM event_lines) SELECT event_id, {STAGE_SQL} AS stage, "
    f"{trim_space(f'regexp_extract(line, {lit(st.STEP)}, 1)')} AS step, {trim_space(f'regexp_extract(line, {lit(st.COMMAND)}, 1)')} AS command FROM c",
)
def line_stages(spark, sf):
    d = demo.event_lines(spark, sf).select("event_id", tx.clean_line(F.col("line")).alias("line"))
    return d.select("event_id", st.line_stage(F.lower("line")).alias("stage"), st.log_step(F.col("line")).alias("step"),
                    st.log_command(F.col("line")).alias("command"))


@register(
    "log_context",
    f"""{EV}, l AS (SELECT log_id, unnest({sql.lines('text')}) AS line, generate_subscripts({sql.lines('text')}, 1) AS n FROM event_logs),
 m AS (SELECT log_id, n, {STAGE_SQL} AS stage, nullif({trim_space(f'regexp_extract(line, {lit(st.STEP)}, 1)')}, '') AS step,
   nullif({trim_space(f'regexp_extract(line, {lit(st.COMMAND)}, 1)')}, '') AS command FROM l)
SELECT e.log_id, coalesce(arg_min(stage, n) FILTER (WHERE stage IS NOT NULL), '') AS stage,
  coalesce(arg_min(step, n) FILTER (WHERE step IS NOT NULL), '') AS step,
  coalesce(arg_min(command, n) FILTER (WHERE command IS NOT NULL), '') AS command
FROM event_logs e LEFT JOIN m USING (log_id) GROUP BY e.log_id""",
)
def log_context(spark, sf):
    d = demo.event_logs(spark, sf).select("log_id", tx.canonicalize_log(F.col("text")).alias("c"))
    c = F.col("c")
    return d.select("log_id", st.log_stage(F.lower(c)).alias("stage"), st.log_step(c).alias("step"), st.log_command(c).alias("command"))


@register(
    "numbered_lines",
    f"SELECT doc_id AS log_id, unnest({sql.lines('text')}) AS line, generate_subscripts({sql.lines('text')}, 1) AS line_no FROM documents",
)
def numbered_lines(spark, sf):
    from culprit.operators.lines import numbered_lines as lines

    return lines(demo.logs(spark, sf)).select("log_id", "line", F.col("line_no").cast("bigint").alias("line_no"))


def _first(*exprs):
    return "coalesce(" + ", ".join(f"nullif({e}, '')" for e in exprs) + ")"


FAILING_SQL = _first(
    f"regexp_extract({trim_space('line')}, {lit(cl.GO_FAIL)}, 1)",
    f"regexp_extract({trim_space('line')}, {lit(cl.PYTEST_FAIL)}, 1)",
    trim_space(f"regexp_extract({trim_space('line')}, {lit(cl.JEST_FAIL)}, 1)"),
)
SALIENT_SQL = f"CASE WHEN {any_of('lower(line)', cl.SALIENT_WORDS)} THEN {collapse('line')} END"


@register("failing_tests", f"{EV} SELECT event_id, {FAILING_SQL} AS test, {SALIENT_SQL} AS error FROM event_lines")
def failing_tests(spark, sf):
    line = tx.trim_space(F.col("line"))
    return demo.event_lines(spark, sf).select(
        "event_id", cl.failing_test(line).alias("test"), F.when(cl.is_salient(line), tx.collapse_space(line)).alias("error")
    )


def score_sql(c):
    words = " + ".join(f"CASE WHEN contains(lower({c}), {lit(w)}) THEN 3 ELSE 0 END" for w in cl.ERROR_WORDS)
    return f"({words} + CASE WHEN strlen({c}) BETWEEN 20 AND 100 THEN 2 WHEN strlen({c}) < 15 THEN -2 WHEN strlen({c}) > 200 THEN -1 ELSE 0 END)"


def noise_sql(c):
    return "(" + " OR ".join(f"starts_with(lower({c}), {lit(p)})" for p in cl.NOISE_PREFIXES) + ")"


def unknown_sql(c, stage):
    whens = " ".join(f"WHEN {any_of(f'lower({c})', w)} THEN '{k}'" for k, w in cl.UNKNOWN_CATEGORIES.items())
    return f"CASE {whens} WHEN {stage} = 'deploy' THEN 'deploy' WHEN {stage} = 'test' THEN 'test' ELSE 'build' END"


@register(
    "line_scores",
    f"{EV}, t AS (SELECT event_id, {trim_space('line')} AS line FROM event_lines) SELECT event_id, {score_sql('line')}::BIGINT AS score, "
    f"{noise_sql('line')} AS noise, {unknown_sql('line', lit(''))} AS category FROM t",
)
def line_scores(spark, sf):
    d = demo.event_lines(spark, sf).select("event_id", tx.trim_space(F.col("line")).alias("line"))
    return d.select("event_id", cl.candidate_score(F.col("line")).cast("bigint").alias("score"),
                    cl.is_noise_line(F.lower("line")).alias("noise"), cl.unknown_category(F.col("line"), F.lit("")).alias("category"))


def in_list(c, names):
    return f"{c} IN ({', '.join(lit(n) for n in names)})"


def pre(c, words):
    return "(" + " OR ".join(f"starts_with({c}, {lit(w)})" for w in words) + ")"


def suf(c, words):
    return "(" + " OR ".join(f"ends_with({c}, {lit(w)})" for w in words) + ")"


def file_class_sql(path):
    p = f"lower({path})"
    b = f"regexp_extract({p}, '[^/]*$')"
    return f"""CASE WHEN {in_list(b, pt.DEPENDENCY_NAMES)} OR {any_of(p, ['requirements', 'poetry.lock'])} THEN 'dependency'
 WHEN {in_list(b, pt.RUNTIME_NAMES)} OR {any_of(p, ['dockerfile', 'runtime'])} THEN 'runtime_toolchain'
 WHEN {in_list(b, pt.CI_NAMES)} OR {pre(p, pt.CI_PREFIXES)} THEN 'ci_config'
 WHEN {pre(b, pt.ENV_PREFIXES)} OR {suf(b, pt.ENV_SUFFIXES)} OR {in_list(b, pt.ENV_NAMES)} OR {any_of(b, ['secret', 'vault'])}
   OR {any_of(p, ['/config/', '/secrets/'])} THEN 'environment'
 WHEN {suf(b, pt.DEPLOY_SUFFIXES)} OR {pre(p, pt.DEPLOY_PREFIXES)} OR {any_of(p, ['kubernetes', 'terraform'])} THEN 'deploy_infra'
 WHEN ends_with({b}, '_test.go') OR {any_of(b, ['.spec.', '.test.'])} OR {any_of(p, ['/tests/', '/testdata/', '/fixtures/'])} THEN 'test_data'
 WHEN {suf(b, pt.SOURCE_SUFFIXES)} THEN 'source_code' END"""


def class_weight_sql(c):
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {w}" for k, (_, w) in pt.FILE_CLASSES.items()) + " ELSE 0 END"


def class_reason_sql(c):
    return "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {lit(r)}" for k, (r, _) in pt.FILE_CLASSES.items()) + " END"


def source_class_sql(path):
    whens = " ".join(f"WHEN {any_of(f'lower({path})', w)} THEN '{k}'" for k, w in pt.PATH_CLASSES.items())
    return f"CASE {whens} ELSE 'production' END"


CONFIG_SQL = (
    f"({in_list('''regexp_extract(path, '[^/]*$')''', pt.CONFIG_NAMES)} OR "
    + " OR ".join(f"regexp_extract(path, '[^/]*$') GLOB {lit(g)}" for g in pt.CONFIG_GLOBS)
    + ")"
)
CI_CONFIG_SQL = f"({pre('path', pt.CI_CONFIG_PREFIXES)} OR {in_list('''regexp_extract(path, '[^/]*$')''', pt.CI_CONFIG_NAMES)})"
SEGMENT_GLOB = (
    "(path GLOB {g} AND NOT contains(path, '/') OR len(list_filter(string_split(path, '/'), lambda s: s GLOB {g})) > 0)"
)


@register(
    "file_classes",
    f"WITH {demo.FILES_SQL}, c AS (SELECT *, {file_class_sql('path')} AS file_class FROM files) SELECT p_partkey, path, file_class, "
    f"({class_weight_sql('file_class')})::DOUBLE AS weight, {class_reason_sql('file_class')} AS reason, {CONFIG_SQL} AS is_config, "
    f"{CI_CONFIG_SQL} AS is_ci_config, {source_class_sql('path')} AS source_class, "
    f"{SEGMENT_GLOB.format(g=lit('*_test.go'))} OR {SEGMENT_GLOB.format(g=lit('deploy'))} OR {SEGMENT_GLOB.format(g=lit('red_*'))} AS glob_hit FROM c",
)
def file_classes(spark, sf):
    p = F.col("path")
    d = demo.files(spark, sf).withColumn("file_class", pt.changed_file_class(p))
    return d.select(
        "p_partkey", "path", "file_class", pt.changed_file_weight(F.col("file_class")).alias("weight"),
        pt.changed_file_reason(F.col("file_class")).alias("reason"), pt.is_config_file(p).alias("is_config"),
        pt.is_ci_config_file(p).alias("is_ci_config"), pt.source_path_class(p).alias("source_class"),
        pt.glob_match_any(p, ["*_test.go", "deploy", "red_*"]).alias("glob_hit"),
    )


TOKENS_SQL = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')))"


@register(
    "token_jaccard",
    f"""WITH p AS (SELECT conv_id, turn, {TOKENS_SQL.format(c='text')} AS a,
  lag({TOKENS_SQL.format(c='text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, len(a)::BIGINT AS n_tokens, CASE WHEN b IS NULL OR len(a) = 0 OR len(b) = 0 THEN 0.0
 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END AS similarity FROM p""",
)
def token_jaccard(spark, sf):
    from pyspark.sql.window import Window as W

    d = demo.table(spark, sf, "conversations").select("conv_id", "turn", tx.token_set(F.col("text")).alias("a"))
    d = d.withColumn("b", F.lag("a").over(W.partitionBy("conv_id").orderBy("turn")))
    return d.select("conv_id", "turn", F.size("a").cast("bigint").alias("n_tokens"),
                    F.coalesce(F.when(F.col("b").isNotNull(), tx.jaccard(F.col("a"), F.col("b"))), F.lit(0.0)).alias("similarity"))


EXEC_PATH_SQL = _first(f"regexp_extract(line, {lit(cl.EXEC_PATH)}, 1)", f"regexp_extract(line, {lit(cl.EXEC_QUOTED)}, 1)")


@register(
    "missing_executables",
    f"""{EV}, m AS (SELECT event_id, {EXEC_PATH_SQL} AS p, nullif(regexp_extract(line, {lit(cl.COMMAND_NOT_FOUND)}, 1), '') AS c FROM event_lines)
SELECT event_id, coalesce(regexp_extract(p, '[^/]*$'), c) AS missing_executable, CASE WHEN contains(p, '/') THEN p END AS expected_path
FROM m WHERE p IS NOT NULL OR c IS NOT NULL""",
)
def missing_executables(spark, sf):
    d = demo.event_lines(spark, sf).select("event_id", cl.missing_executable(F.col("line")).alias("facts"))
    return d.filter(F.size("facts") > 0).select(
        "event_id", F.col("facts")["missing_executable"].alias("missing_executable"), F.col("facts")["expected_path"].alias("expected_path")
    )
