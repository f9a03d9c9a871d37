"""Arrow-batched row functions: one Python call per batch, bounded output batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructType, _parse_datatype_string

import inkwell

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(inkwell)

#: Rows gathered before an output batch is handed back to the JVM.
OUT_ROWS = 16_384


def flat_map(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Each row's columns go through the function that start() returns once per task; its tuples are the new rows."""
    target: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(target)
    width = len(arrow)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, rows = start(), []
        for batch in found:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend(work(*row))
                if len(rows) >= OUT_ROWS:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        lists = list(zip(*rows)) if rows else [()] * width
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(lists, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(batches, target)


@F.pandas_udf(BinaryType())
def deflated(texts: pd.Series) -> pd.Series:
    """Texts as zlib-compressed UTF-8; null for null."""
    return texts.map(lambda t: None if t is None else zlib.compress(t.encode()))


@F.pandas_udf(StringType())
def inflated(packed: pd.Series) -> pd.Series:
    """The inverse of deflated()."""
    return packed.map(lambda b: None if b is None else zlib.decompress(b).decode())
