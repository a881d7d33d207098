"""Shared pieces of the training-data operators: session limits, materialising, byte and word kernels."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes; a longer single text forms a step of its own.
STEP_BYTES = 2 << 20

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker holds a few MB at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for what is run within."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int) -> contextlib.AbstractContextManager[None]:
    """Arrow batches of fewer rows, for what is run within."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where none is configured (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of what was written are of no more use, so Spark is told to remove them at its end.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/quillgraph/{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table from materialize() that no plan to come reads."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quillgraph/" in f}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo k."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(k))


# ---- Arrow batches -------------------------------------------------------------------------------


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and the n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def byte_list(col: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null counts as empty."""
    data, offs = buffers(col)
    raw, o = data.tobytes(), offs.tolist()
    return [raw[a:b] for a, b in zip(o, o[1:])]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts take about `size` bytes (a slice has one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def filter_by_text(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray], size: int = STEP_BYTES) -> DataFrame:
    """The rows whose text is kept, with all columns, whatever their names (mapInArrow itself takes none with dots)."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index('text')}"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, text, size):
            yield b.filter(pa.array(keep(column(b, text))))

    return plain.mapInArrow(apply, plain.schema).toDF(*names)


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: the upper ones, mostly alike, compress to next to nothing."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


# ---- Words ---------------------------------------------------------------------------------------

#: A-Z to a-z, every other ASCII byte that is no digit or letter to a space; bytes from 128 on stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD_NP = np.frombuffer(WORD_TABLE, np.uint8)


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_ODD = U(0x9E3779B97F4A7C15 | 1)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text index) of every word of every text, in order."""
    low = _WORD_NP[data]
    inside = low != 32
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    starts_mask[heads] = inside[heads]
    starts = np.flatnonzero(starts_mask)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()) + 1, _ODD, np.uint64))
    h = np.add.reduceat(_BYTE_CODE[low[at]] * power[place], first)
    doc = np.searchsorted(offs, starts, "right") - 1
    return mix(h + length.astype(np.uint64)), doc


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count) of the multiset of k-word shingles of every text, sorted by both.

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    h, doc = word_hashes(data, offs)
    n = len(h)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    padded, docs = np.append(h, np.zeros(k - 1, np.uint64)), np.append(doc, np.full(k - 1, -1))
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * _ODD + np.where(docs[j : n + j] == doc, padded[j : n + j], U(0))
        s ^= s >> U(31)
    whole = docs[k - 1 : n + k - 1] == doc
    head = np.append(True, doc[1:] != doc[:-1])
    keep = whole | head
    s, d = mix(s[keep]), doc[keep]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1]))
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(s)))


# ---- Characters ----------------------------------------------------------------------------------


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts as code points end to end, and the n+1 offsets; null counts as empty."""
    low = [(t or "").lower() for t in texts]
    offs = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) for t in low], dtype=np.int64)])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32), offs


_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]
