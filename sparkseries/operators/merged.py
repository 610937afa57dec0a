"""Grouped Python aggregates from mergeable states (U2, U3).

Three steps: every task adds its rows to one state per group (Arrow batches; a group holding a third of all rows is
one state per task), states are gathered per (group, salt) and merged, and what is left of a group -- at most
``SALTS`` states -- is gathered, merged and finished.  So no task ever holds a group's rows, and none
more than one ``SALTS``-th of the states of a group.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseries.functions.aggs import AggSpec

SALTS = 64
#: Groups whose states one task keeps before it hands them on (a group handed on twice is merged later).
HELD = 20_000


def merge_groups(src: DataFrame, keys: Sequence[str], specs: Sequence[AggSpec]) -> DataFrame:
    """``keys`` plus one double column per spec (:class:`merged_agg`), one row per group."""
    keys = list(keys)
    names = [f"k{i}" for i in range(len(keys))]
    funcs = [s.func for s in specs]
    x = src.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                   *[F.col(s.column).cast("double").alias(f"v{i}") for i, s in enumerate(specs)])
    key_fields = x.schema.fields[:len(keys)]
    states = T.StructType([*key_fields, T.StructField("s", T.BinaryType())])

    def add(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[tuple, list] = {}

        def rows(types):
            cols = list(zip(*held)) or [()] * len(names)
            packed = [pickle.dumps(s, protocol=pickle.HIGHEST_PROTOCOL) for s in held.values()]
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types)], pa.array(packed, pa.binary())],
                                              names=[*names, "s"])

        types: list = []
        for b in batches:
            types = [b.schema.field(n).type for n in names]
            at = pa.Table.from_batches([b.select(names)]).append_column("at", pa.array(np.arange(b.num_rows)))
            groups = at.group_by(names, use_threads=False).aggregate([("at", "list")])
            values = [b.column(f"v{i}") for i in range(len(funcs))]
            found = [v.is_valid().to_numpy(zero_copy_only=False) for v in values]
            values = [v.to_numpy(zero_copy_only=False) for v in values]
            for key, where in zip(zip(*[groups.column(n).to_pylist() for n in names]),
                                  groups.column("at_list").combine_chunks()):
                where = where.values.to_numpy(zero_copy_only=False)
                state = held.get(key) or [f.start() for f in funcs]
                for i, f in enumerate(funcs):
                    some = values[i][where][found[i][where]]
                    if len(some):
                        state[i] = f.add(state[i], some)
                held[key] = state
            if len(held) > HELD:
                yield rows(types)
                held.clear()
        if held:
            yield rows(types)

    def merger(last: bool):
        def merge(batches):
            import pyarrow as pa

            for b in batches:
                out = []
                for group in b.column(b.num_columns - 1):
                    state, *others = [pickle.loads(s.as_py()) for s in group.values]
                    for other in others:
                        state = [f.merge(p, q) for f, p, q in zip(funcs, state, other)]
                    out.append([f.finish(s) for f, s in zip(funcs, state)] if last else
                               [pickle.dumps(state, protocol=pickle.HIGHEST_PROTOCOL)])
                cols = list(zip(*out)) or [()] * (len(funcs) if last else 1)
                kind = pa.float64() if last else pa.binary()
                ends = [f"o{i}" for i in range(len(funcs))] if last else ["s"]
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], *[pa.array(c, kind) for c in cols]],
                                                 names=[*names, *ends])
        return merge

    done = T.StructType([*key_fields, *[T.StructField(f"o{i}", T.DoubleType()) for i in range(len(specs))]])
    part = x.mapInArrow(add, states).withColumn("salt", F.spark_partition_id() % SALTS)
    part = part.groupBy(*names, "salt").agg(F.collect_list("s").alias("s")).drop("salt").mapInArrow(merger(False), states)
    part = part.groupBy(*names).agg(F.collect_list("s").alias("s")).mapInArrow(merger(True), done)
    return part.select(*[F.col(n).alias(k) for n, k in zip(names, keys)],
                       *[F.col(f"o{i}").alias(s.out) for i, s in enumerate(specs)])
