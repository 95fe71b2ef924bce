"""Token-id store: one zstandard frame a document, compressed with a shared dictionary.

A store is a folder of shards in ascending identifier order, a dictionary
trained on serialised id arrays, and a manifest.  A shard holds the dictionary's
SHA-256, the frames one after another, and an index of identifiers, frame
offsets and token counts, so a short document is read without its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.kernels import bounded_batches, bounded_sample, trimmed
from tidewater.llm.tokens import encoder
from tidewater.plans.scratch import drop_path, durable

MAGIC = b"TWTOKEN1"

#: The dictionary is fitted to pieces of so many characters, at hashed places of at most so many texts that are chosen by hash.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1024, 4096, 32 << 10, 3

#: A shard ends after so many bytes of frames or so many documents.
SHARD_BYTES, SHARD_DOCS = 256 << 20, 1_000_000

#: Bytes of ids in one Arrow batch when a store is read; its frames are read in one request.
BATCH_BYTES = 4 << 20


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _write_file(uri: str, content: bytes) -> None:
    """Write under another name and move into place: a lost writer leaves no half file under the final name."""
    fs, path = _fs(uri)
    part = f"{path}.{hashlib.md5(content).hexdigest()[:8]}.part"
    with fs.open_output_stream(part) as out:
        out.write(content)
    fs.move(part, path)


def train_dictionary(docs: DataFrame, path: str, spaces: str, id_col: str, text_col: str) -> bytes:
    """A zstandard dictionary for packed ids; empty if there is too little to train on.

    It is fitted on one bounded piece of each of at most SAMPLE_DOCS texts, both chosen by hash.
    """
    import zstandard

    full = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    place = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    rows = bounded_sample(full, ["_id", "t"], SAMPLE_DOCS, [F.substring("t", place, F.lit(SAMPLE_CHARS)).alias("t")])
    samples = [s for s in encoder(path, spaces).encode([r.t for r in rows]) if s]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


Batches = Iterator[pa.RecordBatch]


def encoded(docs: DataFrame, path: str, spaces: str, end_id: int, id_col: str, text_col: str, then: Callable[[Batches], Batches], schema: str, cached: int | None = None) -> DataFrame:
    """What ``then`` makes of rows ``(doc_id, ids)``: packed ids of each whole text with ``end_id`` appended; null counts as empty.

    Both run in one worker, as a second one for each task would hold as much memory again.
    ``cached`` bounds the encoder's caches where other work needs the memory; the ids are the same.
    """
    bounded_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaces, cached)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [x + end for x in enc.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(trimmed(lambda batches: then(run(batches))), schema)


def write_store(docs: DataFrame, store: str, path: str, spaces: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode ``docs`` into a new store at URI ``store`` and return its manifest.

    Null identifiers come first; rows that share one are ordered by their
    frames.  An empty table makes a store without shards.
    """
    import zstandard

    raw = train_dictionary(docs, path, spaces, id_col, text_col)
    digest = hashlib.sha256(raw).digest()
    fs, base = _fs(store)
    fs.create_dir(base, recursive=True)
    _write_file(f"{store}/dictionary", raw)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(c.compress, ids), pa.binary())],
                names=["doc_id", "n_tokens", "frame"],
            )

    frames = durable(encoded(docs, path, spaces, end_id, id_col, text_col, compress, "doc_id long, n_tokens long, frame binary"), "frames", "uncompressed")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, done = context.partitionId(), []
        fs, base = _fs(store)
        out, ids, void, sizes, counts, held = None, array("q"), bytearray(), array("q"), array("q"), 0

        def finish() -> None:
            index = ids.tobytes() + bytes(void) + sizes.tobytes() + counts.tobytes()
            out.write(index + struct.pack("<QQ", len(ids), len(index)))
            out.close()
            name = f"{number:06d}-{len(done):04d}.tok"
            fs.move(f"{base}/{name}.{context.taskAttemptId()}.part", f"{base}/{name}")
            done.append((name, len(ids), sum(counts)))
            for column in (ids, sizes, counts):
                del column[:]
            void.clear()

        for b in batches:
            for i, n, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if out is None:
                    out, held = fs.open_output_stream(f"{base}/{number:06d}-{len(done):04d}.tok.{context.taskAttemptId()}.part"), 0
                    out.write(MAGIC + digest)
                out.write(frame)
                held += len(frame)
                ids.append(i or 0)
                void.append(i is None)
                sizes.append(len(frame))
                counts.append(n)
                if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    finish()
                    out = None
        if out is not None:
            finish()
        names, docs, tokens = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(docs, pa.int64()), pa.array(tokens, pa.int64())], names=["shard", "docs", "tokens"])

    # Rows that repeat are told apart by where they are read, so that many of them don't meet in one shard.
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame").asc(), F.col("_tie").asc()]
    placed = frames.withColumn("_tie", F.monotonically_increasing_id())
    rows = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(shard), "shard string, docs long, tokens long").collect()
    drop_path(docs.sparkSession, frames.scratch_path)
    manifest, total = {"dictionary": digest.hex(), "shards": []}, 0
    for r in sorted(rows):
        manifest["shards"].append({"shard": r.shard, "docs": r.docs, "start": total})
        total += r.tokens
    _write_file(f"{store}/manifest.json", json.dumps(manifest).encode())
    return manifest


class Shard:
    """Reads one shard: its index, and any frame by position."""

    def __init__(self, store: str, name: str):
        import zstandard

        fs, base = _fs(store)
        with fs.open_input_stream(f"{base}/dictionary") as f:
            raw = f.read()
        self.file = fs.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, index = struct.unpack("<QQ", self.file.read_at(16, size - 16))
        head, own = self.file.read_at(len(MAGIC) + 32, 0), self.file.read_at(index, size - 16 - index)
        if head != MAGIC + hashlib.sha256(raw).digest():
            raise ValueError(f"{name}: not a shard of this dictionary")
        self.ids = np.frombuffer(own, "<i8", n)
        self.void = np.frombuffer(own, "u1", n, 8 * n).astype(bool)
        self.sizes = np.frombuffer(own, "<i8", n, 9 * n)
        self.counts = np.frombuffer(own, "<i8", n, 17 * n)
        self.offsets = len(head) + np.cumsum(self.sizes) - self.sizes
        self.starts = np.cumsum(self.counts) - self.counts
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)

    def ids_at(self, i: int) -> bytes:
        """Packed ids of the i-th document of the shard, read without the others."""
        return self.reader.decompress(self.file.read_at(int(self.sizes[i]), int(self.offsets[i])))

    def ids_between(self, first: int, stop: int) -> list[bytes]:
        """Packed ids of neighbouring documents, whose frames are read at once."""
        begin = int(self.offsets[first])
        frames = memoryview(self.file.read_at(int(self.offsets[stop - 1] + self.sizes[stop - 1]) - begin, begin))
        return [self.reader.decompress(frames[a : a + n]) for a, n in zip((self.offsets[first:stop] - begin).tolist(), self.sizes[first:stop].tolist(), strict=True)]


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Rows ``(doc_id, start, n_tokens, ids)`` of a store; ``start`` counts the ids of all documents before."""
    fs, base = _fs(store)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        shards = [(s["shard"], s["start"]) for s in json.loads(f.read())["shards"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(store, name)
                at = 0
                while at < len(shard.ids):
                    done = shard.starts[at] * 4
                    stop = min(len(shard.ids), max(at + 1, int(np.searchsorted(shard.starts * 4, done + BATCH_BYTES))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(shard.ids[at:stop], pa.int64(), mask=shard.void[at:stop]),
                            pa.array(start + shard.starts[at:stop]),
                            pa.array(shard.counts[at:stop]),
                            pa.array(shard.ids_between(at, stop), pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = stop

    return spark.createDataFrame(shards, "shard string, start long").repartition(max(1, len(shards))).mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids binary")
