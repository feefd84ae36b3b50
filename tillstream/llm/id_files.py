"""Token-id output: files of independently coded, checksummed blocks, in ascending order of documents.

Documents are sorted by id over range partitions, encoded, and their ids (with an end id each) cut
into blocks of `range_coder.BLOCK` ids. A file row holds a group of whole documents: their ids and
token counts, and the blocks; a block is a count and the CRC-32 of its ids (four bytes each, little
endian) and the coded words. Files are Parquet tables of such rows, partition by partition, so that
they can be written to and read from any store that Spark reaches, and each row is decoded alone.

Defined cases: a null or empty text is the end id alone; equal ids keep the order of a hash of their
texts; null ids come first; an empty table gives no rows; other columns are ignored. A damaged block
raises an error when it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.llm import range_coder
from tillstream.llm.tables import table
from tillstream.llm.textbytes import chunks
from tillstream.llm.tokens import SPAN, default_path, opened, with_end
from tillstream.sources.shared import shared_dir

END_ID = 2
#: Ids of a group at least, unless the partition ends: as many blocks are coded side by side.
GROUP_IDS = 4 << 20
FILE_ROW = "part int, first bigint, n_ids bigint, doc_ids array<bigint>, n_tokens array<int>, blocks array<binary>"


def pack_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of an array of ids below 65,536; larger ones are an error."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("the format holds ids below 65,536")
    size = range_coder.BLOCK
    n, rest = divmod(len(ids), size)
    coded = range_coder.encode(ids[: n * size].reshape(n, size)) if n else []
    if rest:
        coded += range_coder.encode(ids[n * size :].reshape(1, rest))
    raw = ids.astype("<u4")
    parts = [raw[i * size : (i + 1) * size] for i in range(len(coded))]
    return [struct.pack("<II", len(p), zlib.crc32(p.tobytes())) + c for p, c in zip(parts, coded, strict=True)]


def unpack_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of a row's blocks; raises ValueError if a checksum differs."""
    heads = [struct.unpack("<II", b[:8]) for b in blocks]
    out: list[np.ndarray] = [None] * len(blocks)  # type: ignore[list-item]
    for size in {n for n, _ in heads}:
        own = [i for i, (n, _) in enumerate(heads) if n == size]
        for i, row in zip(own, range_coder.decode([blocks[i][8:] for i in own], size), strict=True):
            out[i] = row.astype("<u4")
            if zlib.crc32(out[i].tobytes()) != heads[i][1]:
                raise ValueError("a block's checksum differs")
    return np.concatenate([*out, np.zeros(0, "<u4")])


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, first, encoder = TaskContext.get().partitionId(), 0, opened(path)
    docs: list[int | None] = []
    counts: list[int] = []
    held: list[np.ndarray] = []
    names = [x.split()[0] for x in FILE_ROW.split(", ")]

    def row() -> pa.RecordBatch:
        ids = np.concatenate(held)
        cols = [pa.array([part], pa.int32()), pa.array([first]), pa.array([len(ids)]), pa.array([docs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([pack_blocks(ids)], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for b in batches:
        own = b.column(0).to_pylist()
        for t in chunks(b, size=SPAN):
            ids, offsets = with_end(*encoder.encode(t), end_id)
            n = np.diff(offsets)
            at = 0
            while at < t.n:  # whole documents until the group is large enough
                have = sum(len(x) for x in held)
                stop = min(t.n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + max(1, GROUP_IDS - have), "left"))))
                held.append(ids[offsets[at] : offsets[stop]])
                docs += own[t.first + at : t.first + stop]
                counts += n[at:stop].tolist()
                at = stop
                if sum(len(x) for x in held) >= GROUP_IDS:
                    yield row()
                    first += sum(len(x) for x in held)
                    docs, counts, held = [], [], []
    if docs:
        yield row()


def write_ids(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Writes the id files of all documents."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows.mapInArrow(lambda b: _write(b, path, end_id), FILE_ROW).write.parquet(to)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids, n = unpack_blocks(r["blocks"]), np.array(r["n_tokens"], np.int64)
            ends = np.cumsum(n)
            raw = ids.view(np.uint8)
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
            cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(np.full(len(n), r["part"], np.int32)), pa.array(r["first"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "local", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, decoded from the files."""
    files = spark.read.parquet(at)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per range partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    docs = files.mapInArrow(_read, "doc_id bigint, part int, local bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    to = f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), to)
    return read_ids(spark, to)
