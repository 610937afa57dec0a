"""Reading the shared tables, and tables written to the folder that all executors share."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseries.session import scratch_path

#: Bytes of text in a slice of a record batch.
SLICE = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again: cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def arrow_map(df: DataFrame, make: Callable[[], Callable], schema: str, last: bool = False) -> DataFrame:
    """``mapInArrow`` with state per task: ``make()`` runs once in the task and returns a function
    from a record batch to an iterator of column dictionaries (lists or numpy arrays by name).
    With ``last`` the function is called with None after the task's last batch."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    names, types = target.names, [f.type for f in target]

    def run(batches):
        f = make()
        for b in chain(batches, [None] if last else []):
            for cols in f(b):
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


def slices(batch, at: int, limit: int = SLICE):
    """Yield slices of a record batch with about ``limit`` bytes of text in column ``at`` each: what leaves a task
    slice by slice takes little room in the task and in the JVM that reads it."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.flatnonzero(np.diff(np.cumsum(size) // limit, prepend=-1)).tolist()
    for lo, hi in zip(first, [*first[1:], batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def fold(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo 3 (null for a null id); 1 marks held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id) -> F.Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))
