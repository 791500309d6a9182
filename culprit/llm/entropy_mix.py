"""Mix sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate, the expected number of its copies. Among all rates of at most ``cap``
that give a source its target of words, the chosen ones are closest to 1 in relative entropy. The
convex dual has one multiplier for each source, and its solution tilts exponentially:
``rate = min(cap, exp(multiplier * size / mean size))``. Newton steps on all multipliers at once
need two sums for each source over a table of (source, size, number of documents), which is counted
once with partial aggregation before the shuffle; a hot source is a few partial sums.

Rates become whole copies by a hash of the document, so reruns agree. What rounding leaves of a
source's target is then settled with few documents: from each power of two of the sizes some
documents are offered, and from the largest on one more or one fewer copy is taken where it brings
the source nearer to its target.

Rules: null text is size 0; a null source is a source of its own, after all others; rows that share
an id are documents of their own, and equal rows get equal copies; sources with no words have
target 0; an empty table gives an empty result. One row for each source is brought into order in
one task (weights go by rank); everything that grows with documents is distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culprit.functions.storage import stored
from culprit.llm import rows

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
STEPS, CLOSE = 60, 1e-9
OFFERED = 16  # documents of a source, size class and direction that may settle what rounding leaves


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text that is not null."""
    trimmed = F.btrim(text, F.lit(rows.WHITE_CHARS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"[{rows.WHITE}]+"))).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: ``share`` of all words by weight, at most
    ``cap`` times a source's size, the excess shared anew by weight until no source is above.

    That ends where ``target = least(cap * size, weight * level)``. With sources in order of
    ``cap * size / weight`` the level follows from sums over the capped ones before and the weights after."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    after = ratio.rowsBetween(0, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("weight")).withColumn("level", level)
    # the first source that its share does not fill sets the level for the rest
    final = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return levelled.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("final"))).alias("target"))


def _rate(cap: float) -> Column:
    """The tilted rate; ``multiplier`` null: every document at the cap."""
    tilt = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0)))
    return F.when(F.col("multiplier").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), tilt))


def multipliers(counts: DataFrame, wanted: DataFrame, cap: float = CAP) -> DataFrame:
    """Newton on the dual of every source: ``source, mean, multiplier`` from ``counts(source, size, n)``.

    A step that leaves the interval known to hold the solution is replaced by its middle, so the sums
    decide at least one bit a round. A source whose target is its cap needs no multiplier (null)."""
    by_source = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    now = by_source.join(wanted, by_source["source"].eqNullSafe(wanted["source"])).select(
        wanted["source"], "mean", "target", F.col("source_size").cast("double").alias("total"),
        F.when((F.col("target") < cap * F.col("source_size") * (1 - 1e-12)) & (F.col("source_size") > 0), F.lit(0.0)).alias("multiplier"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.lit(False).alias("done"),
    )
    now = stored(now)
    for _ in range(STEPS):
        rate, scaled = _rate(cap), F.col("size") / F.col("mean")
        free = (F.col("multiplier") * scaled < F.log(F.lit(float(cap)))).cast("int")
        sums = counts.join(now.filter(~F.col("done") & F.col("multiplier").isNotNull()), counts["source"].eqNullSafe(now["source"])).groupBy(now["source"].alias("s")).agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * scaled * rate * free).alias("slope")
        )
        joined = now.join(sums, now["source"].eqNullSafe(sums["s"]), "left")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - gap / F.col("slope")
        middle = F.when(high > 1e5, F.greatest(2 * low, low + 1)).when(low < -1e5, F.least(2 * high, high - 1)).otherwise((low + high) / 2)
        step = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
        at_end = F.col("got").isNull() | (F.abs(gap) <= CLOSE * F.col("total"))
        now = stored(joined.select(
            "source", "mean", "target", "total", F.when(at_end, F.col("multiplier")).otherwise(step).alias("multiplier"),
            F.when(at_end, F.col("low")).otherwise(low).alias("low"), F.when(at_end, F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | at_end).alias("done"),
        ))
        if now.filter(~F.col("done")).isEmpty():
            break
    return now.select("source", "mean", "multiplier")


def _settled(copies: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """``c_source, c_doc, c_key, change``: documents that take one copy more or fewer so that sources meet their targets."""
    taken = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
    left = taken.join(wanted, taken["source"].eqNullSafe(wanted["source"])).select(wanted["source"].alias("s"), (F.col("target") - F.col("got")).alias("left"))
    open_ = copies.filter("size > 0").join(left, copies["source"].eqNullSafe(left["s"]))
    # a document that may go either way is offered for one, by its hash
    up = F.when(F.col("copies") == 0, True).when(F.col("copies") == cap, False).otherwise(F.pmod("key", F.lit(2)) == 0)
    offered = open_.filter(F.col("size") < 2 * F.abs("left")).select("source", "doc", "key", "size", "left", F.when(up, 1).otherwise(-1).alias("sign"), F.floor(F.log2("size")).alias("class"))
    best = W.partitionBy("source", "class", "sign").orderBy("key", "doc")
    offered = offered.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= OFFERED)
    # few rows for each source: OFFERED for each power of two and sign
    item = F.struct((-F.col("size")).alias("order"), "key", "doc", "size", "sign")
    lists = offered.groupBy("source", "left").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.col("left"), F.expr("cast(array() as array<struct<key:bigint,doc:bigint,sign:int>>)").alias("chosen"))

    def take(acc, x):
        then = acc["left"] - x["size"] * x["sign"]
        added = F.concat(acc["chosen"], F.array(F.struct(x["key"].alias("key"), x["doc"].alias("doc"), x["sign"].alias("sign"))))
        return F.when(F.abs(then) < F.abs(acc["left"]), F.struct(then.alias("left"), added.alias("chosen"))).otherwise(acc)

    chosen = lists.select("source", F.explode(F.aggregate("items", start, take)["chosen"]).alias("c"))
    return chosen.select(F.col("source").alias("c_source"), F.col("c.doc").alias("c_doc"), F.col("c.key").alias("c_key"), F.col("c.sign").alias("change"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``doc, key, source, size, source_size, target, copies`` for each row of ``docs``; ``key`` is the hash of its text."""
    sizes = stored(docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("key"), docs["source"].cast("string").alias("source"), n_words(rows.body(docs)).alias("size")))
    counts = stored(sizes.groupBy("source", "size").agg(F.count("*").alias("n")))
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = stored(targets(by_source, weights, share, cap))
    tilt = multipliers(counts, wanted, cap)
    known = wanted.join(tilt, wanted["source"].eqNullSafe(tilt["source"])).select(wanted["source"].alias("s"), "source_size", "target", "mean", "multiplier")
    rate = F.when(F.col("mean") > 0, _rate(cap)).otherwise(F.lit(0.0))
    uniform = F.pmod(F.xxhash64("doc", "key"), F.lit(1 << 30)) / float(1 << 30)
    copies = stored(sizes.join(known, sizes["source"].eqNullSafe(known["s"])).select(
        "doc", "key", "source", "size", "source_size", "target", F.least(F.lit(cap), F.floor(rate + uniform)).cast("int").alias("copies")
    ))
    change = _settled(copies, wanted, cap)
    done = copies.join(change, copies["source"].eqNullSafe(change["c_source"]) & (copies["doc"] == change["c_doc"]) & (copies["key"] == change["c_key"]), "left")
    return done.select("doc", "key", "source", "size", "source_size", "target", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))


def op8(spark, sf_dir: str) -> DataFrame:
    done = mixed(rows.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.select(rows.doc_id(F.col("doc")).alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
