"""Path-dependent folds over ordered rows of a key, in one pass and without holding a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(df: DataFrame, columns: list[str], start: Callable[[], tuple], step: Callable[[tuple, tuple], tuple[tuple, tuple]], outputs: str, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """df and the columns of `outputs` (DDL): step(state, values of `columns`) -> (state, output values), rows of a key by t.

    Rows of a key are sorted into one partition and stream through in Arrow batches; only the state
    is kept from one to the next, so a key of any length takes constant memory.
    """
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(added)
    at = [df.columns.index(c) for c in (*keys, *columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, ()
        for batch in batches:
            made = []
            for row in zip(*(batch.column(i).to_pylist() for i in at)):
                if key != row[: len(keys)]:
                    key, state = row[: len(keys)], start()
                state, out = step(state, row[len(keys) :])
                made.append(out)
            cols = [pa.array(c, f.type) for c, f in zip(zip(*made) if made else [()] * len(arrow), arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=schema.names)

    return df.repartition(*keys).sortWithinPartitions(*keys, "t").mapInArrow(run, schema)
