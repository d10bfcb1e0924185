"""Ordered scans: the rows of each key, in order, through a small function that keeps some state.

One shuffle by key and a sort that Spark spills; a task holds an Arrow batch and the function's state, never the rows of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that a scan hands on.
ROWS = 10_000


def scan(rows: DataFrame, keys: list[str], order: list[str], walk: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """walk(rows of a key in order) for each key; the keys are the first columns of rows and of what comes out (schema: the others)."""
    kinds = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL(schema).fields])
    out, n = to_arrow_schema(kinds), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = (t for b in batches for t in zip(*[c.to_pylist() for c in b.columns], strict=True))
        made = ((*key, *x) for key, group in groupby(tuples, lambda t: t[:n]) for x in walk(t[n:] for t in group))
        while part := list(islice(made, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), out, strict=True)], schema=out)

    return rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)
