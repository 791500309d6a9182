"""Failure signatures that stay equal when only run-specific noise differs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culprit.functions import text as tx
from culprit.functions.paths import generalize_path, looks_like_path

VERSION = "signature.v1"


def normalize_evidence_line(c: Column) -> Column:
    """Mask times, paths, line numbers, ids, addresses and long numbers of one evidence line."""
    c = tx.trim_space(F.regexp_replace(c, tx.jvm(tx.ANSI_ESCAPE), ""))
    c = tx.replace_all(c, tx.SIGNATURE_MASKS_BEFORE_PATHS)
    fields = F.split(tx.collapse_space(c), " ")
    c = F.array_join(F.transform(fields, lambda f: F.when(looks_like_path(f), generalize_path(f)).otherwise(f)), " ")
    c = tx.replace_all(c, tx.SIGNATURE_MASKS_AFTER_PATHS)
    return F.lower(tx.collapse_space(c))


def normalized_evidence(evidence: Column) -> Column:
    """Sorted distinct normalised lines of an evidence array."""
    lines = F.flatten(F.transform(evidence, lambda e: F.split(tx.unix_newlines(e), "\n")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(lines, normalize_evidence_line), lambda l: l != "")))


def _distinct(values: Column, clean) -> Column:
    """Sorted distinct cleaned values, null where none is left (so that the field is left out of the payload)."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean), lambda v: v != "")))
    return F.when(F.size(kept) > 0, kept)


def _token(value: Column) -> Column:
    return F.lower(tx.collapse_space(tx.trim_space(value)))


def _file(value: Column) -> Column:
    bare = F.btrim(F.replace(tx.trim_space(value), F.lit("\\"), F.lit("/")), F.lit("\"'()[]{}<>,;:"))
    return F.when(bare.rlike("^(?:/|[A-Za-z]:/)"), generalize_path(bare)).otherwise(tx.collapse_space(bare))


def trigger_attributes(files: Column, scopes: Column, signals: Column) -> Column:
    """What a finding's triggers have in common beyond their text; null without any."""
    f, n, s = _distinct(files, _file), _distinct(scopes, _token), _distinct(signals, _token)
    return F.when(F.coalesce(f, n, s).isNotNull(), F.struct(f.alias("files"), n.alias("scope_names"), s.alias("signal_ids")))


def signature_payload(rule_id: Column, detector: Column, evidence: Column, title: Column, attributes: Column | None = None) -> Column:
    """JSON text that identifies a failure; falls back to the title, then to the rule id. ``attributes``: see
    :func:`trigger_attributes`."""
    lines = normalized_evidence(evidence)
    fallback = F.filter(
        F.array(normalize_evidence_line(F.coalesce(title, F.lit(""))), rule_id), lambda x: F.coalesce(x, F.lit("")) != ""
    )
    lines = F.when(F.size(lines) > 0, lines).otherwise(F.slice(fallback, 1, 1))
    fields = [F.lit(VERSION).alias("version"), F.trim(rule_id).alias("failure_id"), F.trim(detector).alias("detector"), lines.alias("evidence")]
    return F.to_json(F.struct(*fields, *([] if attributes is None else [attributes.alias("attributes")])))


def signature_hash(rule_id: Column, detector: Column, evidence: Column, title: Column, attributes: Column | None = None) -> Column:
    return F.sha2(signature_payload(rule_id, detector, evidence, title, attributes), 256)
