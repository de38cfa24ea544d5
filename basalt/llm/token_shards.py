"""Token-ID shards: independent zstandard frames with a trailing seek table.

A shard file holds, one after another:
  * data frames: each one zstandard frame of ``FRAME_IDS`` ids (the last may be shorter);
  * one index frame: magic, id width, ids a frame, then doc ids, null flags and id counts;
  * a skippable frame with the seek table of the public zstandard seekable format: for each frame
    its compressed size, decompressed size and the low 32 bits of XXH64 of its content, then the
    number of frames, a descriptor byte (checksums present) and the format's magic number.
A reader fetches the last bytes, the index, and only those frames that hold the wanted documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._scratch import Scratch
from basalt.llm._tokens import encoder, groups
from basalt.llm._totals import before

FRAME_IDS = 1 << 16
# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_MAGIC = b"BTK1"


class ShardWriter:
    """Writes one shard to a binary stream; memory is one frame and 17 bytes a document."""

    def __init__(self, stream, width: int = 4, level: int = 3):
        self.stream, self.width = stream, width
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.table, self.docs, self.nulls, self.counts = [], [], bytearray(), []
        self.pending, self.held = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.stream.write(packed)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        for s in range(0, len(ids), FRAME_IDS):
            part = ids[s : s + FRAME_IDS].astype(f"<u{self.width}", copy=False)
            self.pending.append(part)
            self.held += len(part)
            if self.held >= FRAME_IDS:
                full = np.concatenate(self.pending)
                self._frame(full[:FRAME_IDS].tobytes())
                self.pending, self.held = [full[FRAME_IDS:]], len(full) - FRAME_IDS

    def close(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.pending).tobytes())
        head = INDEX_MAGIC + struct.pack("<BIQ", self.width, FRAME_IDS, len(self.docs))
        self._frame(head + np.array(self.docs, "<i8").tobytes() + bytes(self.nulls) + np.array(self.counts, "<u8").tobytes())
        rows = b"".join(struct.pack("<III", *r) for r in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows)) + rows)


class ShardReader:
    """Random access to one shard through any seekable stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table with checksums")
        stream.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(stream.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        self.zstd = zstandard.ZstdDecompressor()
        index = self.frame(n - 1)
        if index[:4] != INDEX_MAGIC:
            raise ValueError("no index frame")
        self.width, self.frame_ids, k = struct.unpack("<BIQ", index[4:17])
        self.doc_ids = np.frombuffer(index, "<i8", k, 17)
        self.nulls = np.frombuffer(index, "u1", k, 17 + 8 * k).astype(bool)
        self.counts = np.frombuffer(index, "<u8", k, 17 + 9 * k).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def frame(self, i: int) -> bytes:
        self.stream.seek(int(self.at[i]))
        content = self.zstd.decompress(self.stream.read(int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
        if len(content) != self.table[i, 1] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"frame {i} fails its checksum")
        return content

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; decompresses only the frames it lies in."""
        lo, hi = int(self.starts[i]), int(self.starts[i] + self.counts[i])
        parts = []
        while lo < hi:
            k = lo // self.frame_ids
            if self._last[0] != k:
                self._last = (k, np.frombuffer(self.frame(k), f"<u{self.width}"))
            end = min(hi, (k + 1) * self.frame_ids)
            parts.append(self._last[1][lo - k * self.frame_ids : end - k * self.frame_ids])
            lo = end
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """Tokenises ``docs`` in ascending id order into shards below ``folder``; (shard, docs, ids) of each.

    Null text counts as empty (only the end id), null ids come first, rows with equal ids are
    ordered by a hash of their text. An empty table gives no shard. A shard is written under the
    name of its attempt and then moved, so a task that is run again replaces it whole.
    """

    def run(batches):
        writer = None
        enc = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        total = n = 0
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                ids, texts = (c.to_pylist() for c in batch.slice(s, 2048).columns[:2])
                texts = [t or "" for t in texts]
                for lo, hi in groups(texts):
                    if writer is None:
                        files, base = _open(folder)
                        files.create_dir(base, recursive=True)
                        attempt = f"{base}/_attempt-{shard:07d}-{TaskContext.get().taskAttemptId()}"
                        writer = ShardWriter(files.open_output_stream(attempt), width, level)
                    raws = enc.encode(texts[lo:hi])
                    # The ids of all documents at once, each with its end id.
                    whole = np.frombuffer(end.join([*raws, b""]), "<u4").astype(f"<u{width}", copy=False)
                    at = 0
                    for doc_id, raw in zip(ids[lo:hi], raws):
                        k = len(raw) // 4 + 1
                        writer.add(doc_id, whole[at : at + k])
                        at += k
                    total, n = total + at, n + len(raws)
        if writer is not None:
            writer.close()
            writer.stream.close()
            files.move(attempt, f"{base}/shard-{shard:07d}.btk")
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["shard", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    return rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text").mapInArrow(run, "shard long, docs long, ids long")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that ``manifest`` lists."""

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, root = _open(folder)
                name = f"{root}/shard-{shard:07d}.btk"
                with files.open_input_file(name) as stream:
                    reader = ShardReader(stream, stream.size())
                    crc = [zlib.crc32(reader.ids(i).tobytes()) for i in range(len(reader.doc_ids))]
                yield pa.record_batch(
                    [pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls), pa.array(reader.starts + base), pa.array(reader.counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # A stated number of tasks: the rows of the manifest are few bytes and would be coalesced into one.
    based = before(manifest, "shard", "ids", "base").select("shard", "base")
    return based.repartition(max(manifest.count(), 1), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, DataFrame]:
    """Writes the shards and reads them back: (manifest, folder, documents)."""
    work = Scratch(docs.sparkSession, "token-shards")
    folder = work.path("shards")
    manifest = work.table(write_shards(docs, folder, tokenizer_path, end_id, id_col, text_col), "manifest")
    # What tasks left that failed or were lost.
    path, files = work._files(f"{folder}/_attempt-*")
    for left in files.globStatus(path) or []:
        files.delete(left.getPath(), False)
    return manifest, folder, read_shards(manifest, folder)
