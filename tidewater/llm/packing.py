"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram.

Documents are cut into full pieces and one remainder.  The histogram of piece
lengths, at most one number a length, goes to the driver; the packing patterns
made from it go back as a small table of slots, and pieces take slots by their
rank among pieces of their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.token_store import encoded
from tidewater.plans.ranks import running_total
from tidewater.plans.scratch import durable

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ``((length, times), ...)`` with the number of sequences each is used for.

    Lengths are placed longest first, each into the pack with the most space
    left; packs that share a pattern are one entry with a count, so the work
    follows the number of lengths and patterns, never the number of pieces.
    """
    heap: list[tuple[int, int]] = []  # (-space left, number of a pattern)
    packs: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def push(pattern: tuple[tuple[int, int], ...], count: int, space: int) -> None:
        heapq.heappush(heap, (-space, len(packs)))
        packs.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0][0] >= length:
            space, number = heapq.heappop(heap)
            pattern, count = packs[number]
            times = min(-space // length, max(1, left // count))
            used = min(count, left // times)
            packs[number] = (pattern, 0)
            if used < count:
                push(pattern, count - used, -space)
            push((*pattern, (length, times)), used, -space - times * length)
            left -= used * times
        times = max(1, capacity // length)
        if left >= times:
            push(((length, times),), left // times, capacity - times * length)
        if left % times:
            push(((length, left % times),), 1, capacity - left % times * length)
    return [(p, n) for p, n in packs if n]


def slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, first, last, sequence, times, offset)``: ranks first..last of all pieces, shortest first, and where they go."""
    taken, at = {}, 0
    for length in sorted(histogram):
        taken[length] = at
        at += histogram[length]
    out, sequence = [], 0
    for pattern, count in shortest_pack_first(histogram, capacity):
        offset = 0
        for length, times in pattern:
            out.append((length, taken[length], taken[length] + count * times - 1, sequence, times, offset))
            taken[length] += count * times
            offset += length * times
        sequence += count
    return out


def pieces(docs: DataFrame, path: str, spaces: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", cached: int | None = None) -> DataFrame:
    """Rows ``(doc_id, start, length, doc_tokens, ids)``: packed ids of at most ``capacity`` tokens each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for at in range(0, len(ids), 4 * capacity):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, at // 4, len(part) // 4, len(ids) // 4, part))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return encoded(docs, path, spaces, end_id, id_col, text_col, cut, PIECE_SCHEMA, cached)


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, start, length``; other columns stay.

    Sequences are numbered from 0 without gaps, and pieces in one from offset
    0 without gaps.  Rows that repeat are packed as often as they occur; no
    rows give no sequences.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = cut.sparkSession.createDataFrame(slots(histogram, capacity), "_length long, _first long, _last long, _sequence long, _times long, _offset long")
    ranked = running_total(cut, [F.col("length"), F.col("doc_id").asc_nulls_first(), F.col("start")], name="_rank")
    own = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    k = F.col("_rank") - F.col("_first")
    return (
        ranked.join(F.broadcast(places), own)
        .withColumn("sequence_id", F.col("_sequence") + F.floor(k / F.col("_times")).cast("long"))
        .withColumn("offset", F.col("_offset") + k % F.col("_times") * F.col("length"))
        .drop("_rank", "_length", "_first", "_last", "_sequence", "_times", "_offset")
    )


def pack_documents(docs: DataFrame, path: str, spaces: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, cached: int | None = None) -> DataFrame:
    """Pack every whole text of ``docs``: rows ``(doc_id, start, length, doc_tokens, ids_crc32, [ids,] sequence_id, offset)``.

    Null and empty texts are one piece with the end token alone.
    """
    cut = durable(pieces(docs, path, spaces, end_id, capacity, id_col, text_col, cached), "pieces")
    cut = cut.withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut if with_ids else cut.drop("ids"), capacity)
