"""Small helpers around mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, prepare: Callable[[], object] | None = None) -> DataFrame:
    """Apply fn to the columns of each Arrow batch, as lists; it returns the output columns, as lists of any one length.

    prepare is called once a task, before the first batch.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if prepare is not None:
            prepare()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
