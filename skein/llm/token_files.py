"""Token ids as flat unsigned integer files with 64-bit document offsets, read back by memory map.

A shard is three files: <shard>.bin (ids, each an unsigned integer of 2 or 4 bytes), <shard>.idx (64-bit: document
count, then the offset in ids of each document and of the end) and <shard>.doc (64-bit document ids). Documents lie
in ascending doc_id order, within shards and across them. A shard's base, the ids before it, is the prefix sum of the
shards' totals and is kept in the manifest, not in the shards, so that shards can be written in parallel.

Null text is empty: such a document has the end id alone. Rows with equal doc_id follow each other in the order of a
hash of the text. A null doc_id is written as the smallest 64-bit integer and read back as null. An empty table gives no shards.
A very long text is encoded whole by one task. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import zlib
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import common as C
from skein.llm.tokens import encoder

#: Bytes of text a shard gets, about.
SHARD_BYTES = 32 << 20
#: Documents encoded at once.
BATCH = 256


def store(uri: str):
    """(file system, path) of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def _write(system, path: str, parts) -> None:
    """Under a name of this attempt first: a lost or doubled task leaves either no file or a whole one."""
    import uuid

    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        for b in parts:
            out.write(b)
    system.move(own, path)


def _mapped(system, path: str, dtype) -> np.ndarray:
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.empty(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, keep_space: bool = True, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards and returns the manifest: shard int, documents long, ids long, base long (ids before the shard)."""
    spark = C.prepare(docs.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    plain = docs.select(C.hidden(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = plain.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-n // SHARD_BYTES))
    system, root = store(folder)
    system.create_dir(root, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        system, root = store(folder)
        enc = encoder(tokenizer, keep_space)
        end = np.array([end_id], kind).tobytes()
        ids, lengths = [], []

        def chunks():
            for pdf in batches:
                for i in range(0, len(pdf), BATCH):
                    own = pdf.iloc[i : i + BATCH]
                    ids.append(own["doc_id"].to_numpy())
                    for b in enc.encode(list(own["text"])):
                        a = np.frombuffer(b, "<u4")
                        if len(a) and int(a.max()) >> (8 * id_bytes):
                            raise ValueError(f"a token id needs more than {id_bytes} bytes")
                        lengths.append(len(a) + 1)
                        yield a.astype(kind).tobytes() + end

        stream = chunks()
        first = next(stream, None)
        if first is None:
            return
        name = f"{root}/shard-{shard:07d}"
        _write(system, f"{name}.bin", itertools.chain([first], stream))
        offsets = np.concatenate([[len(lengths), 0], np.cumsum(lengths)]).astype("<i8")
        _write(system, f"{name}.idx", [offsets.tobytes()])
        _write(system, f"{name}.doc", [np.concatenate(ids).astype("<i8").tobytes()])
        yield pd.DataFrame({"shard": [shard], "documents": [len(lengths)], "ids": [int(offsets[-1])]})

    ordered = plain.repartitionByRange(int(shards), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    # One row a shard, and a shard holds SHARD_BYTES: the driver gets some tens of bytes for each 32 MB.
    rows = sorted(tuple(r) for r in ordered.mapInPandas(write, "shard int, documents long, ids long").collect())
    bases = itertools.accumulate((r[2] for r in rows), initial=0)
    manifest = [(*r, b) for r, b in zip(rows, bases)]
    _write(system, f"{root}/manifest.json", [json.dumps({"id_bytes": id_bytes, "end_id": end_id, "shards": manifest}).encode()])
    return spark.createDataFrame(manifest, "shard int, documents long, ids long, base long")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, id_bytes: int = 2, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and ids if asked for."""
    C.prepare(spark)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def read(batches):
        system, root = store(folder)
        for pdf in batches:
            for shard, base in zip(pdf["shard"], pdf["base"]):
                name = f"{root}/shard-{shard:07d}"
                ids, index, docs = _mapped(system, f"{name}.bin", kind), _mapped(system, f"{name}.idx", "<i8"), _mapped(system, f"{name}.doc", "<i8")
                offsets = index[1:]
                for i in range(0, len(docs), 2048):
                    own = np.asarray(docs[i : i + 2048])
                    ends = np.asarray(offsets[i : i + len(own) + 1])
                    wide = [ids[a:b].astype("<u4") for a, b in zip(ends[:-1], ends[1:])]
                    out = pd.DataFrame({"doc_id": own, "start": ends[:-1] + base, "n_tokens": np.diff(ends), "ids_crc32": [zlib.crc32(w) for w in wide]})
                    yield out.assign(ids=wide) if with_ids else out

    n = manifest.count()
    if not n:
        manifest = manifest.limit(0)
    return C.shown(manifest.repartition(max(1, n), "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids))
