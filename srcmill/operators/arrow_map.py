"""Appending columns that a Python helper computes, one Arrow batch at a time."""

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Bytes of input that are Python values at a time.
SLICE_BYTES = 256 << 10


def _slices(batch, inputs):
    """A batch in slices of about SLICE_BYTES of the input columns, one row at least."""
    size = sum(batch.column(c).nbytes for c in inputs)
    rows = max(1, batch.num_rows * SLICE_BYTES // max(size, 1))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def append_columns(df, keep, inputs, ddl, function):
    """The `keep` columns as they are, plus the `ddl` columns from `function(*inputs) -> dict` per row.

    Kept columns pass through as Arrow arrays; only the input columns become Python values, a slice at a time, so that a
    worker's memory does not grow with the rows of a batch.
    """
    added = StructType.fromDDL(ddl)
    wanted = list(dict.fromkeys([*keep, *inputs]))
    source = df.select(*wanted)
    out = StructType([source.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(added)

    def run(batches):
        for batch in (part for whole in batches for part in _slices(whole, inputs)):
            rows = [function(*values) for values in zip(*(batch.column(c).to_pylist() for c in inputs))]
            made = [pa.array([r.get(f.name) for r in rows], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + made, names=[*keep, *arrow.names])

    return source.mapInArrow(run, out)
