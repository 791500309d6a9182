"""SpotSigs: signatures are chains of content words that follow a common word.

A text is lower-cased and cut into words of letters and digits. Anchors are the common words below,
the start of each line, and, so that tables and lists without common words get signatures as well,
words whose first code point plus length divides by ``SAMPLE``. A signature is an anchor with the
next two content words; of several anchors in a row the last counts. The fingerprint is the SHA-256
of the sorted set of signatures, and likeness is the Jaccard index of two sets.

Everything here is DataFrame functions. Pairs of near copies come from sets that are partitioned by
their length: with threshold t only lengths of a ratio of at least t can match, so a set meets its
own length class and the next one; there, sets that share one of their rarest signatures are
compared if their lengths and the positions of the shared signature leave t within reach.

Rules: null text is empty and has no signatures; two empty sets are alike (1.0), an empty and
another are not (0.0); documents are in order of id (null first), rows that share an id in order of
the hash of their text; the only document is followed by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culprit.functions.storage import stored
from culprit.llm import rows

#: Frequent function words of English, French, German and Spanish.
COMMON = (
    "the of and to a in is it that for on with as was be by this are or an from at not have which "
    "le la les de des du et un une en que qui dans pour pas sur avec au est ce il elle "
    "der die das und zu den von mit sich ist ein eine auf nicht dem auch als für "
    "el los las y con no se del por al su lo para es"
).split()
SAMPLE = 16
THRESHOLD = 0.8
_LINE, _ANCHOR = "\u0002", "\u0001"


def segments(text: Column) -> Column:
    """Anchors with the content words up to the next anchor, joined by spaces, where there are any."""
    marked = F.concat(F.lit(f"{_LINE} "), F.replace(F.lower(text), F.lit("\n"), F.lit(f" {_LINE} ")))
    words = F.split(marked, f"[^\\p{{L}}\\p{{N}}{_LINE}]+")
    is_anchor = lambda w: w.isin(*COMMON, _LINE) | ((F.ascii(w) + F.length(w)) % SAMPLE == 0)
    joined = F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(is_anchor(w), F.concat(F.lit(_ANCHOR), w)).otherwise(w)), " ")
    return F.filter(F.transform(F.split(joined, _ANCHOR), lambda s: F.rtrim(s)), lambda s: F.instr(s, " ") > 0)


def signatures(segments_: str) -> Column:
    """The sorted set of signatures from a column of ``segments`` (its name, so that it is worked out once)."""
    s = F.col(segments_)

    def chain(x: Column, i: Column) -> Column:
        three = F.substring_index(x, " ", 3)
        following = F.get(s, i + 1)
        return F.when((three != x) | following.isNull() | (F.length(F.translate(x, " ", "")) < F.length(x) - 1), three).otherwise(F.concat(x, F.lit(" "), F.split_part(following, F.lit(" "), F.lit(2))))

    return F.array_sort(F.array_distinct(F.transform(s, chain)))


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index of two sets; 0 without a comparison where their lengths alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).otherwise(common / (small + large - common))


def in_order(docs: DataFrame) -> DataFrame:
    """``bucket, edge, doc, text_key, text``: documents in buckets of neighbouring ids. The first rows of a bucket
    come again in the bucket before (``edge`` 1; the first of all in the last), so that each row's
    successor is in its own bucket. There are at most ``4 * sqrt(n) + 1`` buckets; that bounds the broadcast."""
    plain = docs.select(docs["doc_id"].cast("bigint").alias("doc"), rows.body(docs).alias("text"))
    seen = plain.agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    width = max(1, math.ceil((high - low + 1) / math.ceil(4 * math.sqrt(max(1, seen["n"])))))
    bucket = F.coalesce(F.floor((F.col("doc").cast("double") - float(low)) / float(width)), F.lit(-1))
    placed = plain.select(bucket.alias("bucket"), F.coalesce("doc", F.lit(rows.LOWEST)).alias("doc"), F.xxhash64("text").alias("text_key"), "text")
    edges = placed.groupBy("bucket").agg(F.min("doc").alias("first")).select(
        F.col("bucket").alias("b"), "first", F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.partitionBy())).alias("before")
    )
    joined = placed.join(F.broadcast(edges), F.col("bucket") == F.col("b"))
    at = lambda b, edge: F.struct(F.col(b).alias("bucket"), F.lit(edge).alias("edge"))
    return joined.select("doc", "text_key", "text", F.explode(F.when(F.col("doc") == F.col("first"), F.array(at("bucket", 0), at("before", 1))).otherwise(F.array(at("bucket", 0)))).alias("at")).select("at.*", "doc", "text_key", "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc, n_chars, edited_sha256, sigs, edited_sigs, next_sigs`` for each row of ``docs(doc_id, text)``."""
    order = W.partitionBy("bucket").orderBy("edge", "doc", "text_key")
    pairs = in_order(docs).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    both = pairs.select("bucket", "edge", "doc", "text_key", "text", n.cast("bigint").alias("n_chars"), F.coalesce(edited, F.lit("")).alias("edited"))
    cut = both.select("bucket", "edge", "doc", "text_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), segments(F.col("text")).alias("s"), segments(F.col("edited")).alias("e"))
    sets = cut.select("bucket", "edge", "doc", "text_key", "n_chars", "edited_sha256", signatures("s").alias("sigs"), signatures("e").alias("edited_sigs"))
    return sets.withColumn("next_sigs", F.lead("sigs").over(order)).filter("edge = 0").drop("bucket", "edge")


def fingerprint(sigs: Column) -> Column:
    return F.sha2(F.array_join(sigs, "\n"), 256)


def op1(spark, sf_dir: str) -> DataFrame:
    done = fingerprinted(rows.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        rows.doc_id(F.col("doc")).alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"), F.size("sigs").cast("bigint").alias("n_signatures"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members ``doc, text_key, fingerprint`` and links ``a, b, likeness`` between fingerprints whose sets have a
    Jaccard index of at least ``threshold``. Equal sets are one fingerprint and are never paired; texts
    without signatures have no links."""
    cut = docs.select(rows.doc_number(docs).alias("doc"), F.xxhash64(rows.body(docs)).alias("text_key"), segments(rows.body(docs)).alias("s"))
    members = stored(cut.select("doc", "text_key", signatures("s").alias("sigs")).withColumn("fingerprint", fingerprint(F.col("sigs"))))
    classes = stored(members.filter(F.size("sigs") > 0).select("fingerprint", F.transform("sigs", lambda x: F.xxhash64(x)).alias("sigs")).dropDuplicates(["fingerprint"]))
    each = classes.select("fingerprint", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("holders"))
    ranked = each.join(often.filter("holders > 1"), "sig").withColumn("length_class", F.floor(F.log("n") / F.lit(-math.log(threshold))))
    # positions among the rarest: signatures that nobody shares come before all others
    shared = W.partitionBy("fingerprint")
    position = F.col("n") - F.count("*").over(shared) + F.row_number().over(shared.orderBy("holders", "sig"))
    prefix = ranked.withColumn("at", position).filter(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).select("sig", "length_class", "fingerprint", "n", "at")
    left = prefix.select("sig", "length_class", F.col("fingerprint").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"))
    right = prefix.select("sig", F.explode(F.array("length_class", F.col("length_class") - 1)).alias("length_class"), F.col("fingerprint").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    reach = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    pairs = left.join(right, ["sig", "length_class"]).filter(ordered & (small >= threshold * large - 1e-9) & (reach >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)).select("a", "b").distinct()
    sets = lambda f, s: classes.select(F.col("fingerprint").alias(f), F.col("sigs").alias(s))
    likeness = jaccard(F.col("s_a"), F.col("s_b"), threshold)
    links = pairs.join(sets("a", "s_a"), "a").join(sets("b", "s_b"), "b").select("a", "b", likeness.alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)
    return members.drop("sigs"), links


_SIGS = """list_sort(list_distinct(list_transform(range(1, len({s}) + 1), lambda i:
  CASE WHEN len(string_split({s}[i], ' ')) > 2 OR i = len({s}) THEN array_to_string(string_split({s}[i], ' ')[1:3], ' ')
       ELSE {s}[i] || ' ' || string_split({s}[i + 1], ' ')[2] END)))"""
_SEGMENTS = f"""list_filter(list_transform(string_split(array_to_string(list_transform(list_filter(
  regexp_split_to_array(chr(2) || ' ' || replace(lower({{t}}), chr(10), ' ' || chr(2) || ' '), '[^\\p{{{{L}}}}\\p{{{{N}}}}\\x02]+'), lambda w: w <> ''),
  lambda w: CASE WHEN w IN ({", ".join(f"'{w}'" for w in COMMON)}, chr(2)) OR (unicode(w) + length(w)) % {SAMPLE} = 0 THEN chr(1) || w ELSE w END), ' '), chr(1)),
  lambda s: rtrim(s)), lambda s: contains(s, ' '))"""
OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next
  FROM documents
), e AS (
  SELECT doc_id, text, length(text) AS n, substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2) AS edited FROM d
), s AS (
  SELECT doc_id, n, edited, {_SEGMENTS.format(t="text")} AS s, {_SEGMENTS.format(t="edited")} AS e FROM e
), g AS (
  SELECT doc_id, n, edited, {_SIGS.format(s="s")} AS sigs, {_SIGS.format(s="e")} AS edited_sigs FROM s
), h AS (
  SELECT *, coalesce(lead(sigs) OVER (ORDER BY doc_id), first_value(sigs) OVER (ORDER BY doc_id)) AS next_sigs FROM g
), k AS (
  SELECT *, len(list_intersect(sigs, edited_sigs)) AS c_edited, len(list_intersect(sigs, next_sigs)) AS c_next FROM h
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(sigs, chr(10))) AS fingerprint,
       sha256(array_to_string(edited_sigs, chr(10))) AS edited_fingerprint,
       CASE WHEN len(sigs) + len(edited_sigs) = 0 THEN 1.0::DOUBLE ELSE c_edited / (len(sigs) + len(edited_sigs) - c_edited) END AS near_edited,
       CASE WHEN len(sigs) + len(next_sigs) = 0 THEN 1.0::DOUBLE ELSE c_next / (len(sigs) + len(next_sigs) - c_next) END AS near_next,
       len(sigs) AS n_signatures
FROM k
"""
