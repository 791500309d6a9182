"""What the operators of this folder share about their input rows.

A document is one row. Rows are told apart by ``doc`` (``doc_id``; null counts as the smallest
number) and ``text_key`` (hash of the text), so that repeated ids with other texts stay apart and
repeated rows get equal results. A null text counts as the empty text. Columns of the input travel
in one struct ``row``, so no name of theirs can clash with a working column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id; a real id of this value shares its fate.
LOWEST = -(2**63)
WHITE = "\\x20\\x09-\\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def doc_number(df: DataFrame, column: str = "doc_id") -> Column:
    return F.coalesce(df[column].cast("bigint"), F.lit(LOWEST))


def packed(df: DataFrame) -> Column:
    return F.struct(*[df[c] for c in df.columns])


def doc_id(doc: Column) -> Column:
    """The id behind a document number."""
    return F.when(doc != LOWEST, doc)


def held_out(column: Column) -> Column:
    """Whether the row is kept away from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
