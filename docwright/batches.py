"""Columns computed in Python by Arrow batches: other columns pass as they are, so long ids beside nulls stay exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from docwright.session import own_name


def computed(rows: DataFrame, inputs: list[Column], compute: Callable[..., tuple[Sequence, ...]], added: list[StructField]) -> DataFrame:
    """rows with the fields `added`: compute takes a list of values for each input and gives a sequence for each field."""
    n, names = len(rows.columns), [*rows.columns, *(f.name for f in added)]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*(c.to_pylist() for c in batch.columns[n:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(list(x), kind) for x, kind in zip(made, kinds))], names=names)

    asked = [c.alias(own_name(rows, f"_in{k}")) for k, c in enumerate(inputs)]
    return rows.select(*rows.columns, *asked).mapInArrow(run, StructType([*rows.schema.fields, *added]))
