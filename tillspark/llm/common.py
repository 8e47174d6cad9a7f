"""Helpers shared by the operators: table reading, stage tables on the shared folder, polynomial byte hashes."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so powers have an inverse modulo 2**64
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if os.path.isdir(root):  # else it already came as a zip
            base = os.path.join(tempfile.mkdtemp(prefix="tillspark-py-"), "tillspark")
            sc.addPyFile(shutil.make_archive(base, "zip", root, "tillspark"))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a scratch folder only where it is unset (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tillspark-llm-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stage_path = path
    return back


def unstage(table: DataFrame) -> None:
    """Delete the files of a stage table; what was made of it must have been written."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(table._stage_path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a document row: its id and a hash of its text (repeated ids with different texts stay apart)."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads the bits of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, _BASE if kind == "up" else _BASE_INV, dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _POWERS[kind] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (data[j] + 1) * B**j over j < i, modulo 2**64; length len(data) + 1."""
    out = np.zeros(len(data) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(U64) + U64(1)) * _powers("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of data[start:end] from ``prefix_hash``; equal bytes give equal hashes wherever they stand."""
    inv = _powers("down", len(prefix))
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))
