"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.storage import materialize, shared_dir  # noqa: F401

#: One word separator: ASCII white space only.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id, written as text, falls in the fold."""
    return F.crc32(F.col(doc_id).cast("string")) % folds == fold


def lower_ascii(column):
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def schema_with(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The fields that are kept, and more of them as DDL."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(more).fields])


def lowest_by_hash(rows: DataFrame, key: str, by: str, most: int) -> DataFrame:
    """(key, by, turn): of each value of ``by`` the ``most`` keys of lowest
    hash, with their place among them. A key that stands with two values is
    left out, one that is repeated counts once.

    A value's rows are first thinned to those whose hash lies under a bound
    that about twice as many as are wanted pass, so what meets in one task does
    not grow with the table; the values of ``by`` are taken to be few."""
    own = rows.select(key, by).where(F.col(key).isNotNull() & F.col(by).isNotNull())
    sizes = own.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    part = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    thin = own.join(F.broadcast(sizes), by).where(part <= F.lit(2.0 * most + 200) / F.col("_n"))
    one = thin.groupBy(key).agg(F.min(by).alias(by), F.max(by).alias("_other")).where(F.col(by) == F.col("_other")).drop("_other")
    turn = Window.partitionBy(by).orderBy(part, F.xxhash64(key), key)
    return one.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= most)
