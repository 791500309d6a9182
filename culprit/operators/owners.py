"""Ownership of paths and what it says about a failure.

``owner_rules(repo, idx, pattern, owners)``: later rules win. ``incidents`` hold, per
``(repo, incident)``, the changed and the failing files in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culprit.operators.globs import owner_hits

BOUNDARY, CLUSTERED, MISMATCH, UPSTREAM = (
    "topology.boundary.crossed",
    "topology.failure.clustered",
    "topology.ownership.mismatch",
    "topology.upstream.changed",
)
GRAPH_DEPTH = 2


def _last_rule(paths: DataFrame, owner_rules: DataFrame) -> DataFrame:
    """``repo, path, owners`` of the last rule that fits, for the paths that one fits."""
    return owner_hits(paths, owner_rules).groupBy("repo", "path").agg(F.max_by("owners", "idx").alias("owners"))


def path_owners(files: DataFrame, owner_rules: DataFrame, path: str = "path") -> DataFrame:
    """Owners of each ``(repo, path)`` by the last matching rule; NULL when nobody owns it."""
    owned = _last_rule(files.select("repo", F.col(path).alias("path")), owner_rules).withColumnRenamed("path", path)
    return files.join(owned, ["repo", path], "left")


def owned_dirs(files: DataFrame, owner_rules: DataFrame, path: str = "path") -> DataFrame:
    """Owned directories of the listing, at most two levels deep. What owns the inside of a directory comes before what
    owns its name."""
    parts = F.split(path, "/")
    depth = F.least(F.size(parts) - 1, F.lit(GRAPH_DEPTH))
    prefixes = F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )
    dirs = files.select("repo", F.explode(prefixes).alias("dir")).distinct()
    both = dirs.select("repo", F.explode(F.array("dir", F.concat("dir", F.lit("/")))).alias("path"))
    found = _last_rule(both, owner_rules).withColumn("inside", F.endswith("path", F.lit("/")))
    return found.groupBy("repo", F.regexp_replace("path", "/$", "").alias("dir")).agg(F.max_by("owners", "inside").alias("owners"))


def nearest_owners(files: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """Owners of the nearest owned directory above each path."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(GRAPH_DEPTH))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    keyed = files.select("repo", path).distinct().select("repo", path, F.posexplode(above).alias("depth", "dir"))
    found = keyed.join(dirs, ["repo", "dir"]).groupBy("repo", path).agg(F.max_by("owners", "depth").alias("owners"))
    return files.join(found, ["repo", path], "left")


def _dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def _upstream(incidents: DataFrame) -> DataFrame:
    """Incidents where a changed directory is a failing one or lies above it; changes at the top lie above all."""
    keys = ["repo", "incident"]
    changed, failed = (incidents.select(*keys, F.explode(F.array_distinct(F.transform(k, _dir))).alias("dir")) for k in ("changed", "failed"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ancestors = failed.select(*keys, F.explode(F.array_distinct(F.concat(F.array(F.lit(".")), above))).alias("dir")).distinct()
    return changed.join(ancestors, [*keys, "dir"], "left_semi").select(*keys).distinct().withColumn("upstream", F.lit(True))


def topology_signals(incidents: DataFrame, dirs: DataFrame) -> DataFrame:
    """Ownership signals per incident from its ``changed`` and ``failed`` file arrays."""
    kinds = [incidents.select("repo", "incident", F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "path")) for k in ("changed", "failed")]
    owned = nearest_owners(kinds[0].unionByName(kinds[1]), dirs)
    is_changed = F.col("kind") == "changed"

    def owner_set(cond: Column) -> Column:
        # distinct owners only: the set is bounded by the owners of a repo
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(cond, F.col("owners"))))))

    g = owned.groupBy("repo", "incident").agg(
        owner_set(is_changed).alias("changed_owners"),
        owner_set(~is_changed).alias("failed_owners"),
        F.max(F.when(is_changed & (F.col("pos") == 0), F.col("owners"))).alias("first_changed"),
        F.max(F.when(~is_changed & (F.col("pos") == 0), F.col("owners"))).alias("first_failed"),
    )
    rows = incidents.join(g, ["repo", "incident"], "left").join(_upstream(incidents), ["repo", "incident"], "left")
    no_owner = F.array().cast("array<string>")
    co, fo = F.coalesce("changed_owners", no_owner), F.coalesce("failed_owners", no_owner)
    crossed = (F.size(co) > 0) & (F.size(fo) > 0) & ~F.arrays_overlap(co, fo)
    mismatch = F.coalesce(
        (F.size("first_changed") > 0) & (F.size("first_failed") > 0) & ~F.arrays_overlap("first_changed", "first_failed"), F.lit(False)
    )
    failed_dirs = F.array_distinct(F.transform("failed", _dir))
    upstream = F.coalesce("upstream", F.lit(False))
    top = F.array_distinct(F.transform(failed_dirs, lambda d: F.substring_index(d, "/", 1)))
    clustered = (F.size("failed") >= 2) & (F.size(top) == 1) & (F.get(top, 0) != ".")
    flags = {BOUNDARY: crossed, CLUSTERED: clustered, MISMATCH: mismatch, UPSTREAM: upstream}
    return rows.select(
        "repo", "incident", co.alias("owner_zones"),
        crossed.alias("boundary_crossed"), clustered.alias("failure_clustered"),
        mismatch.alias("ownership_mismatch"), upstream.alias("upstream_changed"),
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])).alias("active_signals"),
    )


def common_dir(paths: Column) -> Column:
    """Deepest directory above all paths of an array, ``.`` when there is none."""
    split = F.transform(paths, lambda p: F.split(_dir(p), "/"))
    first = F.get(split, 0)
    same = F.transform(
        F.sequence(F.lit(1), F.size(first)),
        lambda i: F.when(F.forall(split, lambda s: F.slice(s, F.lit(1), i) == F.slice(first, F.lit(1), i)), F.array_join(F.slice(first, F.lit(1), i), "/")),
    )
    best = F.array_compact(same)
    return F.coalesce(F.get(best, F.size(best) - 1), F.lit("."))
