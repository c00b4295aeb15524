"""Token ids in files of patched frame-of-reference blocks.

A file holds, in this order:
  magic ``BPF1``;
  blocks of up to 128 ids, each: minimum (u4), count (u1), bit width (u1), number of exceptions (u1),
    then the differences to the minimum packed at that width, least bit first, padded to a byte,
    then the exceptions: places (u1 each) and whole differences (u4 each);
  the documents: ids (i8) and numbers of token ids (u4);
  the places of the blocks in the file (u8);
  footer: numbers of documents, blocks and ids (u8 each), magic again.
All numbers are little-endian. The width of a block is the least that holds the given
percentile of its differences; what needs more bits is an exception. The index of
block starts lets a reader begin at any block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_null, identified, lean, shared_dir, table
from .tokens import blank_led, encoder, public_path

MAGIC = b"BPF1"
BLOCK = 128
#: The share of a block's values that its width must hold.
PERCENTILE = 0.9
#: Blocks that are packed or unpacked at once; bounds the memory.
SLAB = 2048
END_ID = 0
#: Rows that a task that reads files hands on at once.
ROWS_AT_ONCE = 20_000
_HEAD = struct.Struct("<IBBB")
_FOOT = struct.Struct("<QQQ4s")


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _holding(width: int) -> np.dtype:
    """The narrowest of 16 and 32 bits that holds so many."""
    return np.dtype("<u2" if width <= 16 else "<u4")


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of BLOCK ids each; the last may be shorter. Any unsigned 32-bit ids; none gives no block."""
    out: list[bytes] = []
    whole = len(ids) // BLOCK * BLOCK
    for at in range(0, whole, SLAB * BLOCK):
        out += _pack(ids[at : min(whole, at + SLAB * BLOCK)].reshape(-1, BLOCK), percentile)
    if whole < len(ids):
        out += _pack(ids[whole:].reshape(1, -1), percentile)
    return out


def _pack(rows: np.ndarray, percentile: float) -> list[bytes]:
    n = rows.shape[1]
    low = rows.min(axis=1)
    diffs = rows - low[:, None]
    bits = bit_lengths(diffs)
    width = np.sort(bits, axis=1)[:, min(n - 1, int(np.ceil(percentile * n)) - 1)]
    over = bits > width[:, None]
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        of = np.flatnonzero(width == w)
        kind = _holding(w)
        kept = np.where(over[of], 0, diffs[of]).astype(kind)
        planes = np.unpackbits(kept.view(np.uint8).reshape(len(of), n, -1), axis=2, bitorder="little")[:, :, :w]
        packed = np.packbits(planes.reshape(len(of), n * w), axis=1, bitorder="little")
        for k, i in enumerate(of.tolist()):
            places = np.flatnonzero(over[i])
            out[i] = _HEAD.pack(int(low[i]), n, w, len(places)) + packed[k].tobytes() + places.astype(np.uint8).tobytes() + diffs[i][places].astype("<u4").tobytes()
    return out


def unpack_blocks(raw: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that begin at starts in raw, one after another."""
    heads = [_HEAD.unpack_from(raw, s) for s in starts]
    parts: list[np.ndarray | None] = [None] * len(starts)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for k, (_, n, w, _) in enumerate(heads):
        by_shape.setdefault((n, w), []).append(k)
    flat = np.frombuffer(raw, dtype=np.uint8)
    for (n, w), of in by_shape.items():
        size = (n * w + 7) // 8
        at = np.array([starts[k] for k in of]) + _HEAD.size
        if w:
            kind = _holding(w)
            planes = np.zeros((len(of), n, 8 * kind.itemsize), dtype=np.uint8)
            planes[:, :, :w] = np.unpackbits(flat[at[:, None] + np.arange(size)], axis=1, bitorder="little", count=n * w).reshape(len(of), n, w)
            diffs = np.packbits(planes, axis=2, bitorder="little").view(kind).reshape(len(of), n).astype(np.uint32)
        else:
            diffs = np.zeros((len(of), n), dtype=np.uint32)
        for row, k, where in zip(diffs, of, (at + size).tolist(), strict=True):
            low, _, _, exceptions = heads[k]
            if exceptions:
                row[flat[where : where + exceptions]] = np.frombuffer(raw, dtype="<u4", count=exceptions, offset=where + exceptions)
            row += np.uint32(low)
            parts[k] = row
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


class Writer:
    """Appends documents to an open binary stream."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, len(MAGIC)
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.starts: list[np.ndarray] = []
        self.rest, self.ids, self.blocks = b"", 0, 0
        stream.write(MAGIC)

    def append(self, doc_ids: list[int], encoded: list[bytes]) -> None:
        self.docs += doc_ids
        self.sizes += [len(x) // 4 for x in encoded]
        raw = b"".join([self.rest, *encoded])
        whole = len(raw) // (4 * BLOCK) * 4 * BLOCK
        self._put(raw[:whole])
        self.rest = raw[whole:]

    def _put(self, raw: bytes) -> None:
        blocks = pack_blocks(np.frombuffer(raw, dtype="<u4"))
        sizes = np.array([len(b) for b in blocks], dtype=np.int64)
        self.starts.append(self.at + np.cumsum(sizes) - sizes)
        self.stream.write(b"".join(blocks))
        self.at += int(sizes.sum())
        self.ids += len(raw) // 4
        self.blocks += len(blocks)

    def close(self) -> None:
        self._put(self.rest)
        self.stream.write(np.array(self.docs, dtype="<i8").tobytes())
        self.stream.write(np.array(self.sizes, dtype="<u4").tobytes())
        self.stream.write(np.concatenate(self.starts).astype("<u8").tobytes())
        self.stream.write(_FOOT.pack(len(self.docs), self.blocks, self.ids, MAGIC))


class Reader:
    """Reads one file; ``ids(first, end)`` reads and unpacks only the blocks that it needs.

    source: the bytes of a file, or a binary file that can seek; of the latter only the index and the asked blocks are held.
    """

    def __init__(self, source) -> None:
        if isinstance(source, bytes):
            self.size, self.read = len(source), lambda at, n: source[at : at + n]
        else:
            self.size = source.seek(0, 2) or source.tell()

            def read(at: int, n: int) -> bytes:
                source.seek(at)
                return source.read(n)

            self.read = read
        whole = self.size >= _FOOT.size + len(MAGIC)
        docs, blocks, self.count, magic = _FOOT.unpack(self.read(self.size - _FOOT.size, _FOOT.size)) if whole else (0, 0, 0, b"")
        if magic != MAGIC or self.read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a file of packed token ids")
        self.end = self.size - _FOOT.size - 8 * blocks - 12 * docs
        held = self.read(self.end, 8 * blocks + 12 * docs)
        self.docs = np.frombuffer(held, "<i8", docs)
        self.sizes = np.frombuffer(held, "<u4", docs, 8 * docs)
        self.starts = np.append(np.frombuffer(held, "<u8", blocks, 12 * docs).astype(np.int64), self.end)

    def ids(self, first: int, end: int) -> np.ndarray:
        if first >= end:
            return np.zeros(0, dtype=np.uint32)
        b, e = first // BLOCK, (end - 1) // BLOCK + 1
        at = int(self.starts[b])
        return unpack_blocks(self.read(at, int(self.starts[e]) - at), (self.starts[b:e] - at).tolist())[first - b * BLOCK : end - b * BLOCK]

    def documents(self):
        """(doc_id, place of its first id, its ids), a slab of blocks at a time; a document over a slab is one array."""
        ends = np.cumsum(self.sizes, dtype=np.int64).tolist()
        k, n = 0, len(ends)
        while k < n:
            first, j = ends[k] - int(self.sizes[k]), k
            while j < n and ends[j] - first <= SLAB * BLOCK:
                j += 1
            j = max(j, k + 1)
            slab = self.ids(first, ends[j - 1])
            for i in range(k, j):
                yield int(self.docs[i]), ends[i] - int(self.sizes[i]), slab[ends[i] - int(self.sizes[i]) - first : ends[i] - first]
            k = j


def file_system(path: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_id_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write part-00000.bpf and so on, in ascending doc_id order over all files.

    Returns (part, docs, ids), one row per file. A task writes under a name of its own and
    renames the file when it is whole, so a task that runs again leaves the same file. A null
    or empty text gives end_id alone; documents that share a doc_id follow each other by text;
    an empty table gives no files. A null doc_id is written as NO_ID, the least number, and so comes first.
    """
    parts = parts or max(2, 2 * docs.rdd.getNumPartitions())
    end = np.array([end_id], dtype="<u4").tobytes()

    @lean
    def run(batches):
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, store, at = encoder(tokenizer_path, blank_led), None, None
        for pdf in batches:
            if not len(pdf):
                continue
            if store is None:
                store, at = file_system(folder)
                store.create_dir(at, recursive=True)
                own = f"{at}/.{part:05d}-{uuid.uuid4().hex}"
                stream = store.open_output_stream(own)
                writer = Writer(stream)
            writer.append(pdf["doc_id"].tolist(), [ids + end for ids in encode(pdf["text"].tolist())])
        encode.rest()
        if store is not None:
            writer.close()
            stream.close()
            store.move(own, f"{at}/part-{part:05d}.bpf")
            yield pd.DataFrame({"part": [part], "docs": [len(writer.docs)], "ids": [writer.ids]})

    return (
        identified(docs)
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInPandas(run, "part int, docs long, ids long")
    )


def read_id_files(spark: SparkSession, folder: str, before: dict[int, int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; before: ids in all files before each part."""

    def run(batches):
        store, at = file_system(folder)
        for pdf in batches:
            for part, ids_before in zip(pdf["part"].tolist(), pdf["before"].tolist()):
                with store.open_input_file(f"{at}/part-{part:05d}.bpf") as f:
                    rows = []
                    for doc, start, ids in Reader(f).documents():
                        rows.append((doc, ids_before + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                        if len(rows) >= ROWS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    names = spark.createDataFrame(list(before.items()) or [(0, 0)], "part int, before long")
    if not before:
        names = names.limit(0)
    return names.repartition(max(1, len(before))).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", id_or_null())


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as id files in the shared folder and report them as read back.

    doc_id, start, n_tokens, ids_crc32 of every row. A null or empty text has the end id alone; rows that share a doc_id follow each
    other by text and come back as often; a null doc_id is the first; an empty table gives no rows; other columns are not read.
    """
    folder = f"{shared_dir(spark)}/ids"
    written = write_id_files(table(spark, sf_dir, "documents"), folder, public_path("byte_bpe_50k.json"))
    before, total = {}, 0
    for row in sorted(written.collect(), key=lambda r: r["part"]):
        before[row["part"]] = total
        total += row["ids"]
    return read_id_files(spark, folder, before)
