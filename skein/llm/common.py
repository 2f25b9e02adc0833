"""What the operators of this subpackage share: the shared folder, words, hashes and compact key blocks.

texts() gives null texts as empty ones, null ids as a number that shown() turns back, and no other column, whatever its name. A block holds
at most BLOCK_ROWS documents and BLOCK_BYTES of text, or one longer text. Of empty tables there are no blocks and no ranges but one.
Tables that written() makes stay in the shared folder until spark.checkpoint.dir is emptied: lost executors may need them until the result is read.
"""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import functools
import gc
import json
import math
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words kept in a worker's word-to-hash table before it is emptied.
CACHE_WORDS = 100_000
#: Rows and bytes of text of a block of documents; a longer text is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Entries that one key range should hold, so that a range fits a task's memory at any input size.
RANGE_ENTRIES = 500_000
#: Rows up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes handed to Python at once; a single row may be larger.
BATCH_BYTES = 4 << 20
#: Slots of the bounded bitmap that thins rows before a shuffle: 2 MB of bits whatever the input.
BITMAP_BITS = 1 << 24

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def _give_back() -> None:
    """Lets workers, which live on from stage to stage, give the memory of large arrays back when they are freed. Without this C library there is nothing to set."""
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.util.find_library("c")
    mallopt = getattr(ctypes.CDLL(libc), "mallopt", None) if libc else None
    if mallopt is not None:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped apart
        mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD


_give_back()

#: Tables of a worker that operators fill and others don't need: they are emptied by release().
held_tables: list[dict] = []


def release() -> None:
    """Empties what an earlier stage left in this worker, which lives on: a stage that holds much itself asks for it when a task starts."""
    full = [t for t in held_tables if t]
    for t in full:
        t.clear()
    if full:
        gc.collect()
        libc = ctypes.util.find_library("c")
        trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
        if trim is not None:
            trim(0)


def prepare(spark: SparkSession) -> SparkSession:
    """Give executors this package, so that workers can import it wherever the driver runs, and bound the bytes of a batch where the session has no bound of its own."""
    app = spark.sparkContext.applicationId
    if int(spark.conf.get(_BATCH, str(1 << 30))) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if app not in _shipped:
        _shipped.add(app)
        root = Path(__file__).resolve().parents[2]
        folder = tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/skein_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted((root / "skein").rglob("*.py")):
                z.write(f, f.relative_to(root))
        spark.sparkContext.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and all runs in one process (tests), under a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", f"file://{base}")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and lost executors don't lose it."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stands for a null id in Python tasks, where a column of integers with nulls would lose digits.
NO_ID = -(1 << 63)


def hidden(id_col: str = "doc_id"):
    return F.coalesce(F.col(id_col).cast("long"), F.expr("-9223372036854775807L - 1L")).alias("doc_id")


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != F.expr("-9223372036854775807L - 1L"), F.col("doc_id")))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more) -> DataFrame:
    """doc_id (hidden), text as bytes (null: empty), and more columns; other columns of the input are left out, whatever their names."""
    return docs.select(hidden(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)


def fold(modulus: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


class WordHashes(dict):
    """64-bit hash of each word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def split(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09 to 0x0D."""
    return text.split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def rolling(hashes: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hash of each window of so many words: a polynomial in an odd base modulo 2^64 over mixed word hashes, by Horner's rule across the window."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = hashes[:n].copy()
    for i in range(1, width):
        h *= np.uint64(base)
        h += hashes[i : i + n]
    return mix(h)


def squeeze(a: np.ndarray) -> bytes:
    """Integers by byte planes, so that equal high bytes cost next to nothing."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def unsqueeze(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64)


@functools.lru_cache(maxsize=1)
def _edges(ranges: int) -> np.ndarray:
    """Where so many equal ranges of the 64-bit space start; made once in a worker."""
    return np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)


def range_starts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of so many equal ranges of the 64-bit space starts in sorted keys, and the end."""
    return np.append(np.searchsorted(keys, _edges(ranges)), len(keys))


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted keys."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def extent(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    rows, size = docs.select(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    return rows, size or 0


def ranges_of(size: int, per_word: float = 1.0) -> int:
    """Key ranges for so many bytes of text, about six a word."""
    return max(1, math.ceil(size / 6 * per_word / RANGE_ENTRIES))


def ranges_for(docs: DataFrame, per_word: float = 1.0, text_col: str = "text") -> int:
    return ranges_of(extent(docs, text_col)[1], per_word)


def gathered(batches, columns=("doc_id", "text"), apart: str | None = None):
    """Lists of the columns' values, a block at a time, from pandas batches with texts as bytes. apart: a boolean column; its rows get blocks of their own."""
    held: dict[bool, tuple[list, ...]] = {}
    size: dict[bool, int] = {}
    text = columns.index("text")
    for pdf in batches:
        kinds = pdf[apart] if apart else [False] * len(pdf)
        for kind, *row in zip(kinds, *(pdf[c] for c in columns)):
            kind, n = bool(kind), len(row[text])
            if kind in held and (size[kind] + n > BLOCK_BYTES or len(held[kind][0]) >= BLOCK_ROWS):
                yield held.pop(kind)
            if kind not in held:
                held[kind], size[kind] = tuple([] for _ in columns), 0
            size[kind] += n
            for kept, x in zip(held[kind], row):
                kept.append(x)
    yield from held.values()


_BLOCKS = "block long, ids binary, sizes binary, marks binary, texts binary, carried binary"


def block_table(docs: DataFrame, mark=None, carry=None) -> DataFrame:
    """texts() rows as a table of blocks in the shared folder, a row each, so that every later reading finds the same blocks whatever happened to executors meanwhile.

    mark (an expression, 0 to 255) is kept with each document; documents with mark 1 get blocks of their own. carry (a
    string expression) is kept as well and never looked at.
    """
    none = F.lit("")
    marked = docs.select("doc_id", "text", (F.lit(0) if mark is None else mark).cast("int").alias("mark"), (none if carry is None else F.coalesce(carry, none)).alias("carried"))

    def build(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        with_kind = (pdf.assign(apart=pdf["mark"] == 1) for pdf in batches)
        for i, (ids, texts, marks, carried) in enumerate(gathered(with_kind, ("doc_id", "text", "mark", "carried"), "apart")):
            sizes = np.array([len(t) for t in texts], np.int64)
            row = first + i, np.array(ids, np.int64).tobytes(), sizes.tobytes(), np.array(marks, np.uint8).tobytes(), zstandard.compress(b"".join(texts), 3), zstandard.compress(json.dumps(carried).encode(), 1)
            yield pd.DataFrame([row], columns=[x.split()[0] for x in _BLOCKS.split(", ")])

    return written(marked.mapInPandas(build, _BLOCKS), "uncompressed")


def block_rows(ids: bytes, sizes: bytes, marks: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The documents of a block: ids, texts and marks."""
    flat, ends = zstandard.decompress(texts) if len(sizes) else b"", np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return np.frombuffer(ids, np.int64), [flat[a:b] for a, b in zip([0, *ends], ends)], np.frombuffer(marks, np.uint8)


def carried_of(packed: bytes) -> list[str]:
    return json.loads(zstandard.decompress(packed))


def bitmap(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of 64-bit keys, as rows (word, bits): BITMAP_BITS / 64 rows at most. A key's slot is its low bits."""
    slot = f"({column} & {BITMAP_BITS - 1}L)"
    return keys.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, cast({slot} & 63 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))


def thinned(df: DataFrame, column: str, bits: DataFrame) -> DataFrame:
    """Rows whose key's slot is set: all rows with a key of the bitmap, and few others while it is sparse. The side broadcast is bounded by BITMAP_BITS."""
    slot = f"({column} & {BITMAP_BITS - 1}L)"
    return df.withColumn("word", F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(bits), "word").where(f"bits & shiftleft(1L, cast({slot} & 63 AS int)) != 0").drop("word", "bits")


def checked(side: DataFrame, rows: int | None = None) -> DataFrame:
    """The side with a broadcast hint if it has few rows, by count; else as it is."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= BROADCAST_ROWS else side
