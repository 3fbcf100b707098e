"""Shared helpers: shared scratch tables, table access, bounded label samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch; bounds a Python worker's memory where texts are long.
ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the session's Arrow batches to what Python workers can hold; smaller bounds of the caller's stay."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        own = re.match(r"[0-9]+$", spark.conf.get(key, None) or "")
        if not own or not 0 < int(own[0]) <= most:
            spark.conf.set(key, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where it is unset, a local
    session (tests) gets a temporary folder; on a cluster that would be each
    machine's own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int) -> tuple[DataFrame, float | None]:
    """A bounded sample for fitting, as (text, label, place), and the share of 1 among all labelled ids.

    Rows of fold 0 are left out.  An id counts once, with its smallest label and
    its smallest text.  The ids are chosen from the labels alone, in the order of
    a hash of the id, at most ``per_class`` of each class, so the choice is fixed
    and the broadcast of ids is bounded; of their texts those are taken, in that
    order, with which a class stays within ``class_bytes`` bytes.  A text of more
    than a sixteenth of that takes no part, so that it keeps no other out.  ``place``
    is that order.  Ids of any type are compared as text.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("string").alias("id"), F.col(label).cast("int").alias("label"), fold(F.col("doc_id")).alias("fold"))
    usable = usable.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (F.col("fold") != 0)).groupBy("id").agg(F.min("label").alias("label"))
    usable = usable.withColumn("order", F.xxhash64("id"))
    ids = [r for y in (0, 1) for r in usable.where(F.col("label") == y).orderBy("order", "id").limit(per_class).collect()]
    chosen = spark.createDataFrame([tuple(r) for r in ids], "id string, label int, order long")
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "order").agg(F.min("text").alias("text"))
    texts = texts.where(F.octet_length("text") <= class_bytes // 16)
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy("order", "id"))  # at most per_class rows each
    sample = texts.withColumn("so_far", so_far).where(F.col("so_far") <= class_bytes)
    share = usable.agg(F.avg("label").alias("p")).first().p
    return sample.select("text", "label", F.struct("order", "id").alias("place")), share


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a ridge for each column."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def to_share(y: np.ndarray, share: float | None) -> np.ndarray:
    """Weights that give the rows of a balanced sample the real share of 1."""
    own = y.mean()
    share = own if share is None else min(max(share, 0.001), 0.999)
    return np.where(y == 1, share / max(own, 1e-9), (1 - share) / max(1 - own, 1e-9))


def filled(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls count as empty."""
    column = filled(column)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: first row, last row + 1, bytes, offsets.

    A text longer than that makes a run of its own.
    """
    data, offsets = raw(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
