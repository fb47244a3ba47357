"""Python functions of a row's values as Arrow-batched column functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

SLICE = 200  # rows whose values are Python objects at a time


def sliced(batches, rows=SLICE):
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def by_row(f, kind: str, arrow: pa.DataType, rows=SLICE):
    """A function of columns that has f of their values in each row. kind, arrow: the result's type, in both spellings."""

    def run(*columns: pa.Array) -> pa.Array:
        made = [pa.array([f(*values) for values in zip(*(c.slice(at, rows).to_pylist() for c in columns))], arrow) for at in range(0, len(columns[0]), rows)]
        return pa.concat_arrays(made) if made else pa.array([], arrow)

    return F.arrow_udf(run, kind)


STRINGS = ("array<string>", pa.list_(pa.string()))
COUNTS = ("map<string,int>", pa.map_(pa.string(), pa.int32()))
