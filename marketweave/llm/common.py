"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.session import new_shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_rows(documents: DataFrame, *columns) -> DataFrame:
    """The columns a task needs of a table of texts. Texts go to Python in batches of 1000 rows
    instead of 10000 unless the session says otherwise: a batch is held in memory several times."""
    conf = documents.sparkSession.conf
    if conf.get(BATCH_ROWS, None) is None:
        conf.set(BATCH_ROWS, "1000")
    return documents.select(*columns)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where df has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def spool(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder, packed tightly, and read it back: later jobs neither
    recompute it nor depend on the executors that made it."""
    path = new_shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def byte_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is the empty text."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def plain_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def text_digest(column: str):
    """Key of a text among rows with the same id; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))


def listed_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Integer arrays by byte planes, compressed; zero planes cost next to nothing."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.compress(head + b"".join(planes), level)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as unsigned integers."""
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 + 16 * n
    for count, width in np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist():
        plane = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
        out.append(np.ascontiguousarray(plane).view(f"<u{width}").ravel())
        at += count * width
    return out
