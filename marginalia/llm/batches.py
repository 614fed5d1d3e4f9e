"""Row-wise work on Arrow batches: ids pass through untouched (nulls included), texts become Python strings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


#: Rows that are Python objects at a time.
SLICE = 256


def over_rows(df: DataFrame, keep: Sequence[str], inputs: Sequence[str], made: str,
              work: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Columns ``keep`` of ``df`` and the columns ``made`` (a schema string), which a function gives for each row.

    ``work()`` runs once per task and returns that function of the ``inputs``. Columns are taken by position, so names of
    other columns can't clash.
    """
    slim = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], *[df[c].alias(f"v{i}") for i, c in enumerate(inputs)])
    schema = StructType([*slim.schema.fields[:len(keep)], *StructType.fromDDL(made).fields])
    arrow = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema.fields[len(keep):]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = work()
        for whole in batches:
            for batch in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                values = [batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))]
                columns = zip(*[fn(*row) for row in zip(*values)])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(len(keep))], *[pa.array(c, f.type) for c, f in zip(columns, arrow)]],
                    names=[f.name for f in schema.fields])

    out = slim.mapInArrow(run, schema)
    return out.select(*[out[f"k{i}"].alias(c) for i, c in enumerate(keep)], *[f.name for f in arrow])


def keep_rows(df: DataFrame, inputs: Sequence[str], work: Callable[[], Callable[..., tuple[bool]]]) -> DataFrame:
    """The rows of ``df``, with all columns, for which a function of the ``inputs`` is true."""
    verdict = "keep"
    while verdict in df.columns:
        verdict += "_"
    return over_rows(df, df.columns, inputs, f"{verdict} boolean", work).where(verdict).drop(verdict)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
          "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
          "array<string>": pa.list_(pa.string())}
