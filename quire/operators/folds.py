"""A Python step over one group of rows at a time, many groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that leave a task at once.
BATCH = 20_000


def in_order(*columns: str) -> Callable[[dict], tuple]:
    """Sort key of rows: by these columns, nulls last."""
    return lambda row: tuple((row[c] is None, row[c]) for c in columns)


def folded(rows: DataFrame, key: list[str], columns: list[str], each: Callable[[tuple, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """What each(values of the key, rows of a group) gives, as rows of the schema. Groups are gathered by Spark and reach Python as lists, so that a small one
    costs no data frame of its own; one group is held at a time, with those of its batch."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for b in batches:
            for *values, group in zip(*b.columns, strict=True):
                found.extend(each(tuple(v.as_py() for v in values), group.as_py()))
                if len(found) >= BATCH:
                    yield batch(found)
                    found = []
        if found:
            yield batch(found)

    return rows.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("_rows")).mapInArrow(step, schema)
