"""What the operators of this subpackage share: tables, the shared folder, small SQL pieces."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import release, save, shared_dir  # noqa: F401  (the operators take them from here)

#: The characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: The struct of the columns that an operator passes through.
OTHERS = "__others"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a Parquet table with Spark, whatever file system `sf_dir` is on."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of texts that go to a Python worker together.
TEXTS = 1_000


def give_back() -> None:
    """Give a Python worker's free memory back to the system: between tasks it waits beside other workers
    and the JVM, whose memory it would narrow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hold(df: DataFrame, needed: list[str]) -> DataFrame:
    """The columns `needed`, and all others in one struct, where no name of an operator's own can
    clash with theirs; `held` gives them back."""
    others = [c for c in df.columns if c not in needed]
    return df.select(*map(_quoted, needed), *([F.struct(*(F.col(_quoted(c)) for c in others)).alias(OTHERS)] if others else []))


def held(columns: list[str], needed: list[str]) -> list[Column]:
    """What to select to have `columns` again of a table that went through `hold`."""
    return [F.col(_quoted(c)) if c in needed else F.col(f"{OTHERS}.{_quoted(c)}").alias(c) for c in columns]


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few(df: DataFrame, rows: int, each: int) -> DataFrame:
    """`df`, of about `rows` rows, in tasks of `each` of them, but enough tasks for every core and no more
    than it has already: what is small is not gone through in as many tasks as there are partitions."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """The maximal runs without white space of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACES), lambda w: w != "")
