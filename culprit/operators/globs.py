"""Paths against many globs or ownership patterns: candidates by equal keys, then one regex for each candidate.

Every pattern gets the keys of which one must be among the keys of any path that fits it: a literal
segment, a literal directory above, or a literal beginning or end of a segment. Paths and patterns meet
in an equi-join on these keys; a pattern that is all wildcards has the empty key. Candidates are verified in
Arrow batches, where each regex is compiled once a task.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.functions import paths as pt

DEEP = 8  # characters of a beginning or end that make a key


def fits(text: Column, rx: Column) -> Column:
    """Whether a regex that is data is found in a text."""

    def run(texts: pa.Array, patterns: pa.Array) -> pa.Array:
        compiled = {p: re.compile(p) for p in set(patterns.to_pylist()) if p is not None}
        return pa.array([t is not None and p is not None and compiled[p].search(t) is not None for t, p in zip(texts.to_pylist(), patterns.to_pylist(), strict=True)])

    return F.arrow_udf(run, "boolean")(text, rx)


def _edges(c: Column, tag: str, ends: bool = True) -> Column:
    """Keys of the beginnings (and ends) of a text of up to ``DEEP`` characters."""
    n = F.sequence(F.lit(1), F.least(F.length(c), F.lit(DEEP)))
    first = F.transform(n, lambda i: F.concat(F.lit(tag + "^"), F.left(c, i)))
    keys = F.concat(first, F.transform(n, lambda i: F.concat(F.lit(tag + "$"), F.right(c, i)))) if ends else first
    return F.when(F.length(c) > 0, keys).otherwise(F.array().cast("array<string>"))


def text_keys(c: Column, tag: str) -> Column:
    """All keys under which a segment (or a whole path) may be asked for by :func:`glob_key`."""
    return F.concat(F.array(F.lit(tag), F.concat(F.lit(tag + "="), c)), _edges(c, tag))


def glob_key(pattern: Column, tag: str) -> Column:
    """The key of a glob that must fill a segment (or a whole path)."""
    first, last = F.regexp_extract(pattern, "^[^*?]*", 0), F.regexp_extract(pattern, "[^*?]*$", 0)
    return (
        F.when(~F.rlike(pattern, F.lit("[*?]")), F.concat(F.lit(tag + "="), pattern))
        .when((first != "") & (F.length(first) >= F.length(last)), F.concat(F.lit(tag + "^"), F.left(first, F.lit(DEEP))))
        .when(last != "", F.concat(F.lit(tag + "$"), F.right(last, F.lit(DEEP))))
        .otherwise(F.lit(tag))
    )


def glob_hits(files: DataFrame, globs: DataFrame) -> DataFrame:
    """``file`` with the columns of ``globs(pattern, ...)`` for each distinct file and fitting glob: a glob without a slash
    fills one segment of the path, one with a slash the whole path."""
    whole = F.contains("pattern", F.lit("/"))
    key = F.when(whole, glob_key(F.col("pattern"), "w")).otherwise(glob_key(F.col("pattern"), "s"))
    keyed = globs.withColumn("_key", key).withColumn("_rx", pt.glob_to_regex(F.col("pattern")))
    paths = files.select("file").distinct()
    segments = paths.select("file", F.explode(F.array_distinct(F.split("file", "/"))).alias("_text"))

    def met(texts: DataFrame, tag: str, some: DataFrame) -> DataFrame:
        return texts.select("_text", F.explode(text_keys(F.col("_text"), tag)).alias("_key")).join(some, "_key").filter(fits(F.col("_text"), F.col("_rx"))).drop("_key", "_rx")

    in_segment = segments.join(met(segments.select("_text").distinct(), "s", keyed.filter(~whole)), "_text").drop("_text")
    in_path = met(paths.select(F.col("file").alias("_text")), "w", keyed.filter(whole)).withColumnRenamed("_text", "file")
    return in_segment.unionByName(in_path)


def owner_keys(pattern: Column) -> Column:
    """Keys of an ownership pattern (see :func:`culprit.functions.paths.owner_regex`)."""
    p = F.regexp_replace(pattern, "^/", "")
    wild = F.rlike(p, F.lit("[*?]"))
    literal = F.regexp_extract(p, "^[^*?]*", 0)
    # literal text that every fitting path begins with: its last segment may go on, the directories above may not
    above, begun = F.regexp_extract(literal, "^(?:.*/)?", 0), F.regexp_extract(literal, "[^/]*$", 0)
    under = F.when(begun != "", F.concat(F.lit("d^"), above, F.left(begun, F.lit(DEEP)))).when(above != "", F.concat(F.lit("d="), F.regexp_replace(above, "/$", ""))).otherwise(F.lit(""))
    folder = F.regexp_replace(p, "/$", "")
    below = F.concat(F.lit("d^"), F.regexp_extract(folder, "^(?:.*/)?", 0), F.left(F.regexp_extract(folder, "[^/]*$", 0), F.lit(DEEP)))
    return (
        F.when(F.endswith(p, F.lit("/")), F.array(F.when(wild | (folder == ""), F.lit("")).otherwise(below)))
        .when(F.contains(p, F.lit("/")), F.array(F.when(wild, under).otherwise(F.concat(F.lit("d="), p))))
        .when(F.contains(p, F.lit("**")), F.array(F.lit("")))
        .when(wild, F.array(glob_key(p, "b")))
        .otherwise(F.array(F.concat(F.lit("b="), p), F.concat(F.lit("d="), p)))
    )


def path_keys(path: Column) -> Column:
    """All keys under which :func:`owner_keys` may ask for a path without leading slash."""
    parts = F.split(path, "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("above"), F.get(parts, i - 1).alias("name"))
    )
    slash = lambda s: F.when(s["above"] == "", F.lit("")).otherwise(F.concat(s["above"], F.lit("/")))
    whole = F.transform(steps, lambda s: F.concat(F.lit("d="), slash(s), s["name"]))
    begun = F.flatten(F.transform(steps, lambda s: F.when(F.length(s["name"]) > 0, F.transform(
        F.sequence(F.lit(1), F.least(F.length(s["name"]), F.lit(DEEP))), lambda i: F.concat(F.lit("d^"), slash(s), F.left(s["name"], i))
    )).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(F.array(F.lit("")), whole, begun, text_keys(F.element_at(parts, -1), "b")))


def owner_hits(paths: DataFrame, owner_rules: DataFrame) -> DataFrame:
    """``repo, path, idx, owners`` of every rule that fits a distinct ``(repo, path)``."""
    p = F.regexp_replace("path", "^/", "")
    rules = owner_rules.select("repo", "idx", "owners", pt.owner_regex(F.col("pattern")).alias("_rx"), F.explode(owner_keys(F.col("pattern"))).alias("_key"))
    keyed = paths.select("repo", "path").distinct().select("repo", "path", F.explode(path_keys(p)).alias("_key"))
    return keyed.join(rules, ["repo", "_key"]).filter(fits(p, F.col("_rx"))).select("repo", "path", "idx", "owners")
