"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift.operators.graph import components, discard, shared_dir, written

__all__ = ["by_id", "components", "discard", "forest", "give_back", "in_slices", "partitions_for", "shared_dir", "table", "texts_as_bytes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame) -> int:
    """Shuffle partitions that follow the input: the session's number, or two for each scan split beyond it."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions(), 1)


def by_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ascending order over the partitions, nulls first; rows of one id are dealt by their text's hash."""
    tie = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.repartitionByRange(partitions_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")


ROWS_AT_ONCE = 500


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time, so that few texts are Python objects at once; at the end give_back()."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def give_back() -> None:
    """Memory that a task has freed goes back to the system: its worker stays for other tasks, of other stages too."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the links that is not the smallest of its component: at most one row a node, however dense the links are."""
    if not len(u):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]
