"""Differential reasoning: adjust ranked candidates by signals and tell rivals apart."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from culprit.functions import text as tx
from culprit.functions.classify import confidence_band
from culprit.functions.signals import DEFAULT_WEIGHTS, SIGNALS, Signal, described, split_signal
from culprit.functions.stage import log_stage
from culprit.functions.tables import small_table
from culprit.operators.match import prepare_logs

ROLES = ["support", "contradict", "discriminator", "exclude"]
MAX_ALTERNATIVES = 2
ITEM_COLUMNS = {"rule_id": "string", "role": "string", "idx": "int", "signal": "string", "weight": "double", "description": "string"}


def hypothesis_items(spark: SparkSession, records: Iterable[Mapping]) -> DataFrame:
    """Item table of rules given as dicts with a ``hypothesis`` block of (signal, weight, description) lists."""
    rows = [
        {"rule_id": r["rule_id"], "role": role, "idx": i, "signal": s, "weight": float(w), "description": d}
        for r in records
        for role in ROLES
        for i, (s, w, d) in enumerate(r.get("hypothesis", {}).get(role, []))
    ]
    return small_table(spark, rows, ITEM_COLUMNS)


def _needed(signals: Sequence[str], registry: Mapping[str, Signal]) -> list[str]:
    """The signals and, for unions and negations, what they refer to."""
    out: list[str] = []

    def add(name: str) -> None:
        if name in out:
            return
        if name in registry and registry[name].kind in ("union", "absent"):
            for ref in registry[name].values:
                add(ref)
        out.append(name)

    for s in signals:
        add(s)
    return out


def evaluate_signals(
    logs: DataFrame,
    signals: Sequence[str],
    registry: Mapping[str, Signal] | None = None,
    log_id: str = "log_id",
    text: str = "text",
    delta: DataFrame | None = None,
) -> DataFrame:
    """Per log a map signal -> evidence lines, holding the matched signals only.

    ``delta(log_id, signal, detail)`` are change signals of the log. Each log is read once for
    all signals; the keyword lists ride along as one constant array.
    """
    registry = registry or SIGNALS
    needed = _needed([s.strip() for s in signals], registry)
    lists = {}
    for name in needed:
        head, value = split_signal(name)
        if name in registry and registry[name].kind == "log":
            lists[name] = registry[name].values
        elif head in ("log.contains", "log.absent"):
            lists[f"log.contains:{value}"] = [value]
    d = prepare_logs(logs, text).select(log_id, "canonical", "norm", log_stage(F.col("norm")).alias("stage"))
    if delta is not None:
        per_log = delta.groupBy(log_id).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "detail")))).alias("delta"))
        d = d.join(per_log, log_id, "left")
    else:
        d = d.withColumn("delta", F.lit(None).cast("map<string,string>"))
    table = F.array(
        *[
            F.struct(F.lit(n).alias("signal"), F.array(*[F.lit(" ".join(p.lower().split())) for p in ps]).alias("ps"))
            for n, ps in lists.items()
        ]
    ) if lists else F.array().cast("array<struct<signal:string,ps:array<string>>>")
    lines = F.split("canonical", "\n")
    first = F.transform(
        table, lambda s: F.struct(s["signal"].alias("signal"), F.get(F.filter(s["ps"], lambda p: F.contains(F.col("norm"), p)), 0).alias("p"))
    )
    found = F.transform(
        F.filter(first, lambda x: x["p"].isNotNull()),
        lambda x: F.struct(
            x["signal"].alias("key"),
            F.slice(F.array_distinct(F.filter(lines, lambda l: F.contains(F.lower(l), x["p"]))), 1, 3).alias("value"),
        ),
    )
    d = d.select(log_id, "stage", "delta", F.map_from_entries(found).alias("log_signals"))
    none = F.array().cast("array<string>")
    parts: dict[str, Column] = {}

    def log_part(key: str) -> Column:
        return F.try_element_at("log_signals", F.lit(key))

    def delta_part(key: str) -> Column:
        detail = F.try_element_at("delta", F.lit(key))
        return F.when(F.coalesce(F.map_contains_key("delta", key), F.lit(False)), F.when(F.trim(detail) != "", F.array(F.trim(detail))).otherwise(none))

    stage_evidence = F.when(F.col("stage") != "", F.array(F.concat(F.lit("stage: "), "stage"))).otherwise(none)
    for name in needed:
        head, value = split_signal(name)
        if name in registry:
            kind, values = registry[name].kind, registry[name].values
            if kind == "log":
                parts[name] = log_part(name)
            elif kind == "delta":
                parts[name] = delta_part(values[0])
            elif kind == "absent":
                parts[name] = F.when(parts[values[0]].isNull(), none)
            else:
                lines_ = F.array_distinct(F.concat(*[F.coalesce(parts[v], none) for v in values]))
                parts[name] = F.when(F.size(lines_) > 0, lines_)
        elif head == "log.contains":
            parts[name] = log_part(f"log.contains:{value}")
        elif head == "log.absent":
            parts[name] = F.when(log_part(f"log.contains:{value}").isNull(), none)
        elif head == "delta.signal":
            parts[name] = delta_part(value)
        elif head == "delta.absent":
            parts[name] = F.when(delta_part(value).isNull(), none)
        elif head == "context.stage":
            parts[name] = F.when(F.col("stage") == value.lower(), stage_evidence)
        elif head == "context.stage.absent":
            parts[name] = F.when(F.col("stage") != value.lower(), stage_evidence)
        else:
            parts[name] = F.lit(None).cast("array<string>")
    entries = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in parts.items()]) if parts else F.array().cast(
        "array<struct<key:string,value:array<string>>>"
    )
    return d.select(log_id, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("signals"))


def assess(ranked: DataFrame, signals: DataFrame, items: DataFrame, registry: Mapping[str, Signal] | None = None, log_id: str = "log_id") -> DataFrame:
    """Adjusted score, elimination and reasons of every candidate, and the new order."""
    registry = registry or SIGNALS
    words = described(F.col("signal"), registry)
    role_order = F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)])
    weights = F.create_map(*[F.lit(x) for k, v in DEFAULT_WEIGHTS.items() for x in (k, v)])
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, weights[F.col("role")]).otherwise(F.col("weight"))
    own = F.when(F.col("role") == "discriminator", F.nullif(F.trim(F.coalesce("description", F.lit(""))), F.lit("")))
    prepared = items.withColumn("signal", F.trim("signal")).select(
        "rule_id", "role", "idx", "signal", role_order[F.col("role")].alias("o"),
        F.coalesce(F.when(F.col("role") == "contradict", -F.abs(w)).otherwise(w), F.lit(0.0)).alias("w"),
        words.alias("plain"),
        F.coalesce(own, words).alias("text"),
    )
    specs = prepared.groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "idx", "role", "signal", "w", "plain", "text"))).alias("spec")
    )
    rows = ranked.join(signals, log_id, "left").join(specs, "rule_id", "left")
    spec = F.coalesce("spec", F.array().cast("array<struct<o:int,idx:int,role:string,signal:string,w:double,plain:string,text:string>>"))
    rows = rows.withColumn("spec", spec).withColumn(
        "hit", F.filter("spec", lambda i: F.coalesce(F.map_contains_key("signals", i["signal"]), F.lit(False)))
    )

    def of(role: str) -> Column:
        return F.filter("hit", lambda i: i["role"] == role)

    def texts(c: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(c, lambda i: F.trim(i["text"])), lambda t: t != ""))

    final = F.aggregate(F.filter("hit", lambda i: i["role"] != "exclude"), tx.round2(F.col("score")), lambda a, i: tx.round2(a + i["w"]))
    keys = F.array_sort(F.transform(F.filter("hit", lambda i: i["role"].isin("support", "discriminator")), lambda i: i["signal"]))
    fallback = F.slice(F.filter(F.transform("evidence", lambda e: F.trim(e)), lambda e: e != ""), 1, 2)
    keys = F.when(F.size(keys) > 0, keys).when(F.size(fallback) > 0, F.array_sort(fallback)).otherwise(F.array("rule_id"))
    excludes_then_contradicts = F.concat(
        F.filter("spec", lambda i: i["role"] == "exclude"), F.filter("spec", lambda i: i["role"] == "contradict")
    )
    out = rows.select(
        *[c for c in ranked.columns],
        final.alias("hypothesis_score"),
        (F.size(of("exclude")) > 0).alias("eliminated"),
        (F.size("hit") > 0).alias("reasoned"),
        F.slice(texts(F.concat(of("support"), of("discriminator"))), 1, 3).alias("why"),
        F.slice(texts(of("contradict")), 1, 2).alias("why_less_likely"),
        F.slice(texts(of("exclude")), 1, 2).alias("ruled_out_by"),
        F.slice(F.array_distinct(F.transform(excludes_then_contradicts, lambda i: i["plain"])), 1, 3).alias("disproof_checks"),
        F.concat_ws("|", F.trim("category"), F.array_join(keys, "|")).alias("rivalry_key"),
    )
    order = W.partitionBy(log_id).orderBy(
        F.asc("eliminated"), F.desc("hypothesis_score"), F.desc("score"), F.desc("confidence"), F.asc("rule_id")
    )
    return out.withColumn("new_rank", F.row_number().over(order))


def differential(assessed: DataFrame, log_id: str = "log_id", alternatives: int = MAX_ALTERNATIVES) -> DataFrame:
    """Likely cause, alternatives and ruled-out causes of each log that has any reasoning.

    One candidate per rivalry key is kept; alternatives are limited, ruled-out ones are not.
    """
    per_log = W.partitionBy(log_id)
    first = F.first(F.struct("hypothesis_score", "why")).over(per_log.orderBy("new_rank"))
    d = assessed.withColumn("_any", F.max("reasoned").over(per_log)).filter("_any").withColumn("_lead", first)
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(log_id, "rivalry_key").orderBy("new_rank"))).filter("_k = 1")
    bucket = F.when(F.col("new_rank") == 1, "likely").when(F.col("eliminated"), "ruled_out").otherwise("alternative")
    d = d.withColumn("status", bucket)
    position = F.row_number().over(W.partitionBy(log_id, "status").orderBy("new_rank"))
    d = d.withColumn("position", position).filter((F.col("status") != "alternative") | (F.col("position") <= alternatives))
    lead = F.col("_lead")
    behind = (F.col("hypothesis_score") != 0) & (lead["hypothesis_score"] > F.col("hypothesis_score"))
    said = F.when(
        F.size(lead["why"]) > 0, F.concat(F.lit("it lacked the stronger discriminator: "), F.get(lead["why"], 0))
    ).otherwise(
        F.format_string("it trailed the likely cause by %.2f points", tx.round2(lead["hypothesis_score"] - F.col("hypothesis_score")))
    )
    less = F.when(
        (F.col("status") == "alternative") & (F.size("why_less_likely") == 0) & behind, F.array(said)
    ).otherwise(F.col("why_less_likely"))
    return d.withColumn("why_less_likely", less).select(
        log_id, "status", "position", "rule_id", "title", "category", tx.round2(F.col("confidence")).alias("confidence"),
        confidence_band(F.col("confidence")).alias("confidence_text"), "hypothesis_score", "why", "why_less_likely",
        "ruled_out_by", "disproof_checks",
    )


def competing(diff: DataFrame, rule_id: str, log_id: str = "log_id") -> DataFrame:
    """Other candidates around a rule: higher-ranked, alternative, ruled out."""
    reasons = (
        F.when(F.col("status") == "likely", F.col("why"))
        .when(F.col("status") == "alternative", F.col("why_less_likely"))
        .otherwise(F.col("ruled_out_by"))
    )
    return diff.filter(F.col("rule_id") != rule_id).select(
        log_id, F.when(F.col("status") == "likely", "higher_ranked").otherwise(F.col("status")).alias("status"), "rule_id", "title",
        "confidence", "confidence_text", reasons.alias("reasons"),
    )
