"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting by which an action's shuffle files are deleted when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own bound of the rows that go to a Python worker together.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Spark's own bound of generated methods, in bytes of code. Beyond 8,000 the JVM never compiles a method, but runs it step by step.
_METHOD = {"spark.sql.codegen.hugeMethodLimit": "8000"}

#: Parquet's own settings: bytes of a row group, and the rows after which it looks whether a page is full.
_WIDE = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Runtime settings for one action; the session's own come back after it."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`. Where it is unset a temporary folder is
    made and set on a local master (tests, one machine); on a cluster that raises RuntimeError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            path = set_dir.get()
        elif spark.sparkContext.master.startswith("local"):
            path = f"file://{tempfile.mkdtemp(prefix='assay-')}"
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def save(df: DataFrame, name: str, compression: str = "snappy", batch: int | None = None, small_methods: bool = False, wide: bool = False) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what came before. Shuffle files go with the write.
    `batch`: rows that its Python steps get together, where rows are wide. `small_methods`: steps of
    very many expressions are generated singly, in methods that the JVM compiles. `wide`: rows of
    megabytes, of which few are held before they are written and few read together."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/assay-{uuid.uuid4().hex}/{name}"
    with _set(spark, {_CLEANUP: "true"} | ({_BATCH: str(batch)} if batch else {}) | (_METHOD if small_methods else {})):
        df.write.options(compression=compression, **(_WIDE if wide else {})).parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    saved.shared_path = path
    return saved


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing still to be computed reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.shared_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path.getParent(), True)
