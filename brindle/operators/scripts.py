"""Sources to rows: the one Python stage. Equal sources are read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import jslex

NAMES = ("file_url", "category", "value_type", "value", "method", "line")
SCHEMA = "source_hash string, category string, value_type string, value string, method string, line int"


def read_sources(sources: DataFrame, file_url: str = "file_url", source: str = "source") -> DataFrame:
    """Findings and literals of ``sources`` (file_url, source). Sources that can't be read give no rows."""
    keyed = sources.select(F.col(file_url).alias("file_url"), F.col(source).alias("source"), F.sha2(source, 256).alias("source_hash"))
    distinct = keyed.groupBy("source_hash").agg(F.first("source").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *r) for h, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in jslex.read(s or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.string()] * 5 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["source_hash", *NAMES[1:]])

    rows = distinct.mapInArrow(run, SCHEMA)
    return keyed.select("file_url", "source_hash").join(rows, "source_hash").select(*NAMES)
