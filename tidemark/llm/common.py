"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage  # noqa: F401  operators call it from here

#: Rows per Arrow batch. Texts are long, so batches are kept small.
BATCH_ROWS = 1000
#: Stands for a null doc_id in join keys.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_batches(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow where f takes and gives dicts of columns (lists or numpy arrays)."""
    fields = [x.strip().split(" ")[:2] for x in schema.split(",")]
    kinds = {
        "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "array<string>": pa.list_(pa.string()),
    }
    arrow = pa.schema([(n, kinds[k]) for n, k in fields])

    owner = f.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(owner)
        dicts = ({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches)
        for out in f(dicts):
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)
        give_back()

    return df.mapInArrow(run, schema)


#: What an operator keeps in a worker between tasks, by module; a worker that serves another operator drops it.
KEPT: dict[str, dict] = {}


def forget_others(owner: str) -> None:
    for module, kept in KEPT.items():
        if module != owner:
            kept.clear()


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on and serves other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def longs(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as numpy."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def document_key(df: DataFrame) -> list:
    """Two columns, kd and kt, that name a row by its doc_id and text. Rows that repeat share them."""
    return [F.coalesce(df["doc_id"].cast("long"), F.lit(NULL_ID)).alias("kd"), F.xxhash64(F.coalesce(df["text"], F.lit(""))).alias("kt")]
