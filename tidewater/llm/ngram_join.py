"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct word shingles, here called tokens.  Documents
with equal sets are one class.  Tokens are counted over classes by an exchange
of packed arrays; a class whose tokens in common with others are too few for
any partner leaves, first judged on the tokens with the lowest hashes, then on
whole sets.  What stays is indexed rarest token first: single tokens of the
extended prefix for rare ones, pairs of tokens for frequent ones.  Classes that
meet in the index are verified on whole sets and linked.

Large groups of near copies do not make all pairs: in rounds, members of an
index entry are compared with a few hubs, and an entry whose members are all
connected is done.  An entry that is still large and mixed is divided by
combinations of one token more, with the prefix extended by one.  What is left
is compared member by member, each only at the set sizes that what it can still
share there allows, so no link between two components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import bounded_batches, mix, shingle_sets, trim, trimmed
from tidewater.llm.rows import few, keep_rows, row_key
from tidewater.plans.components import components
from tidewater.plans.scratch import durable, temporary

#: Similarity of 3/4 as integers, so that limits are exact.
NUM, DEN = 3, 4

#: Shingles are this many words.
WORDS = 5

#: Share of a set, lowest hashes first, that the first pass looks at; and the shared part of a set that any partner must then have.
HEAD_SHARE, HEAD_SLACK = 0.4, 0.4 - (1 - NUM / DEN)

#: Tokens in more classes than this are frequent.
FREQUENT = 12

#: Pairs of frequent tokens are indexed for up to this many of them in an extended prefix; beyond it each token is.
MOST_PAIRED = 12

#: Packed tokens of one exchange part, about; least and most tokens of a block of documents, and tokens that a block has for each part.
PART_TOKENS, BLOCK_TOKENS, ROW_TOKENS = 500_000, (500_000, 4_000_000), 64

#: A token in more texts of a block than this is sent as one count.
LOCAL = 8

#: The number of a text that stands for "a count, no text", and the most texts of a block.
NOBODY, BLOCK_TEXTS = 65535, 60_000

#: Entries with more members are divided, up to so many times, if that makes fewer than one row for so many pairs.
LARGE, DIVISIONS, PAIRS_A_ROW = 4096, 2, 1000

#: Rounds: hubs of an index entry, and whether a document meets only one of all its hubs.
ROUNDS = ((1, True), (4, True), (32, False))


#: Words of 64 bits in a set's parity bitmap.
BITMAP = 8
BITS = [f"b{j}" for j in range(BITMAP)]


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def document_keys(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """Rows ``(doc_id, place, n, k1, k2)``: the row's key, set size and a 128-bit digest of the set as two longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, hi, lo = [], [], []
            for s in shingle_sets(b.column(2), words):
                d = np.frombuffer(hashlib.blake2b(_binary(s), digest_size=16).digest(), "<i8")
                n.append(len(s))
                hi.append(d[0])
                lo.append(d[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["doc_id", "place", "n", "k1", "k2"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    return own.mapInArrow(trimmed(run), "doc_id long, place long, n long, k1 long, k2 long")


def classes_of(keyed: DataFrame) -> DataFrame:
    """Rows ``(class, n, k1, k2, doc_id, place, times)``, one for each distinct set that is not empty.

    ``doc_id, place`` name the class's first row, null identifiers last, and
    ``times`` counts the rows that share both.  Classes are numbered; the
    written table keeps the numbers.
    """
    rows = keyed.where("n > 0").groupBy("k1", "k2", "n", "doc_id", "place").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "place", "times")).alias("first")
    found = rows.groupBy("k1", "k2", "n").agg(first)
    return durable(found.select(F.monotonically_increasing_id().alias("class"), "n", "k1", "k2", "first.doc_id", "first.place", "first.times"), "classes")


def needed(n: np.ndarray | int, share: float) -> np.ndarray | int:
    """Tokens that a set of ``n`` must share, among those looked at, with any partner."""
    if share >= 1:
        return -(-NUM * n // DEN)
    return np.ceil(HEAD_SLACK * NUM / DEN * n - 1e-9)


def _pack(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The slices of ``values`` between ``cuts`` as one binary column, without a copy a slice."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _column(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in table[name]]


def token_counts(texts: DataFrame, parts: int, share: float) -> DataFrame:
    """For each class: ``(id, n, tokens, counts)`` of its tokens that other classes have too, as packed arrays.

    ``texts``: (id, text), one row a class.  A block of documents sends its
    tokens, ten bytes each, to the parts that their hashes name; a token that
    many of its texts have is sent once, with a count.  A part counts classes
    and sends the shared tokens back to the block.  What names the block's
    documents, and the texts of the tokens sent as counts, travels once a block.
    Blocks grow with the parts, so that rows stay large; tokens exchanged grow
    in proportion to the input.
    """
    most = int(np.clip(ROW_TOKENS * parts, *BLOCK_TOKENS))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: list[np.ndarray] = []
        sizes: list[int] = []
        own: list[int] = []
        blocks = [0]

        def flush():
            ids, ns = np.array(own, np.int64), np.array(sizes, np.int32)
            tokens = np.concatenate(todo)
            where = np.repeat(np.arange(len(todo), dtype=np.uint16), [len(t) for t in todo])
            order = np.argsort(tokens, kind="stable")
            tokens, where = tokens[order], where[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(tokens)])
            often = times > LOCAL
            beside = np.repeat(often, times)
            side_tokens, side_docs = tokens[beside], where[beside]
            where[first[often]] = NOBODY
            beside[first[often]] = False
            tokens, where, weights = tokens[~beside], where[~beside], times[often].astype(np.int32)
            # Parts are ranges of tokens, named by the upper half of their bits.
            part = ((tokens >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
            cuts = np.r_[begin, len(part)]
            counted = np.r_[0, np.cumsum(where == NOBODY)][cuts]
            # Blocks of the same rows are told apart by where they were cut, which a task that runs again repeats.
            name = _binary(np.array([TaskContext.get().partitionId(), blocks[0]])) + _binary(ids)
            block = int.from_bytes(hashlib.blake2b(name, digest_size=8).digest(), "little", signed=True)
            blocks[0] += 1
            n = len(begin)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[begin].astype(np.int32)), pa.array(np.full(n, block)), none, none, _pack(tokens, cuts), _pack(where, cuts), _pack(weights, counted)], names=names)
            head = [_binary(x) for x in (ids, ns, side_tokens, side_docs)]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - block % parts], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (*head, b""))], names=names)

        names = ["part", "block", "ids", "sizes", "tokens", "docs", "counts"]
        held = 0
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), WORDS), strict=True):
                head = s if share >= 1 else s[: int(len(s) * share) + 1]
                todo.append(head)
                sizes.append(len(s))
                own.append(i)
                held += len(head)
                if held >= most or len(todo) == BLOCK_TEXTS:
                    yield from flush()
                    todo.clear()
                    sizes.clear()
                    own.clear()
                    held = 0
        if todo:
            yield from flush()

    def count(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return table.drop_columns(["part"])
        trim()
        tokens, docs, weights = _column(table, "tokens", np.uint64), _column(table, "docs", np.uint16), _column(table, "counts", np.int32)
        every, who = np.concatenate(tokens), np.concatenate(docs)
        times = np.ones(len(every), np.int64)
        times[who == NOBODY] = np.concatenate(weights)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]]
        total = np.add.reduceat(times[order], np.flatnonzero(new))
        counts = np.empty(len(every), np.int32)
        counts[order] = np.minimum(total, 2**31 - 1)[np.cumsum(new) - 1]
        ends = np.r_[0, np.cumsum([len(t) for t in tokens])]
        shared = counts > 1
        cuts = np.r_[0, np.cumsum(shared)][ends]
        none = pa.nulls(len(tokens), pa.binary())
        return pa.table({"block": table["block"], "ids": none, "sizes": none, "tokens": _pack(every[shared], cuts), "docs": _pack(who[shared], cuts), "counts": _pack(counts[shared], cuts)})

    def gather(table: pa.Table) -> pa.Table:
        trim()
        heads = [i for i, x in enumerate(table["ids"]) if x.is_valid]
        head = table.slice(heads[0], 1)
        rest = table.filter(pa.array([i not in heads for i in range(len(table))]))
        ids, sizes = _column(head, "ids", np.int64)[0], _column(head, "sizes", np.int32)[0]
        side_tokens, side_docs = _column(head, "tokens", np.uint64)[0], _column(head, "docs", np.uint16)[0]
        cat = lambda c, kind: np.concatenate([np.zeros(0, kind), *_column(rest, c, kind)])
        tokens, docs, counts = cat("tokens", np.uint64), cat("docs", np.uint16), cat("counts", np.int32)
        if len(side_tokens):
            sums = docs == NOBODY
            order = np.argsort(tokens[sums])
            side_counts = counts[sums][order][np.searchsorted(tokens[sums][order], side_tokens)]
            tokens, docs, counts = np.r_[tokens[~sums], side_tokens], np.r_[docs[~sums], side_docs], np.r_[counts[~sums], side_counts]
        order = np.lexsort((tokens, counts, docs))
        tokens, docs, counts = tokens[order], docs[order], counts[order]
        cuts = np.searchsorted(docs, np.arange(len(ids) + 1))
        enough = np.flatnonzero((np.diff(cuts) >= np.maximum(1, needed(sizes.astype(np.int64), share))) & (sizes > 1))
        full = lambda a: pa.array([_binary(a[cuts[i] : cuts[i + 1]]) if share >= 1 else b"" for i in enough], pa.binary())
        return pa.table({"id": pa.array(ids[enough]), "n": pa.array(sizes[enough].astype(np.int64)), "tokens": full(tokens), "counts": full(counts)})

    packed = texts.mapInArrow(trimmed(scatter), "part int, block long, ids binary, sizes binary, tokens binary, docs binary, counts binary")
    counted = packed.groupBy("part").applyInArrow(count, "block long, ids binary, sizes binary, tokens binary, docs binary, counts binary")
    return counted.groupBy("block").applyInArrow(gather, "id long, n long, tokens binary, counts binary")


def pick(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, text)``: one text for each row of ``classes`` (class, doc_id, place, times); they are broadcast if few enough."""
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), row_key(id_col, text_col).alias("place"), F.col(text_col).alias("text"))
    # A row's key is a hash: the identifier is compared too.
    found = texts.join(few(classes.select("class", "doc_id", "place")), "place").where(F.col("_doc").eqNullSafe(F.col("doc_id")))
    found = found.select(F.col("class").alias("id"), "text")
    again = classes.where("times > 1").select(F.col("class").alias("id"))
    if again.isEmpty():
        return found
    again = few(durable(again, "repeated-classes"))
    return found.join(again, "id", "left_anti").unionAll(found.join(again, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))


def first_texts(docs: DataFrame, keyed: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(id, text)`` of all rows but those whose set an earlier row has; ``id`` is the row's key.

    Rows that go are usually the fewer, so their keys are broadcast rather than
    those of the rows that stay.
    """
    start = classes.select("k1", "k2", "n", F.col("doc_id").alias("first"), F.col("place").alias("other"))
    later = keyed.where("n > 0").join(start, ["k1", "k2", "n"]).where((F.col("place") != F.col("other")) | ~F.col("doc_id").eqNullSafe(F.col("first")))
    texts = docs.select(F.col(id_col).cast("long").alias("_doc"), row_key(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    gone = few(durable(later.select(F.col("place").alias("_place"), "doc_id").distinct(), "later-rows"))
    return texts.join(gone, (F.col("id") == F.col("_place")) & F.col("_doc").eqNullSafe(F.col("doc_id")), "left_anti").select("id", "text")


def index_entries(counted: DataFrame) -> DataFrame:
    """Rows ``(entry, kind, id, k, at, n, s, b0..)`` of the token-combination index.

    A combination has ``k`` tokens, the last at place ``at`` of the document's
    list.  ``s`` and the bitmap are the number and parities of a document's tokens in
    common with others: bits in which two bitmaps differ are tokens that only
    one of the sets has, which bounds what the sets can share.

    Two partners share at least needed(n) >= 2 tokens, so the two least of the
    shared ones, by (count, hash), lie in both prefixes extended by one.  If the
    least is rare, its entry (kind 0) holds both.  Else both are frequent, and
    the pair's entry (kind 0) holds both documents, or a single token's does if
    one of them has more than MOST_PAIRED frequent tokens there: those write
    kind 1, the others also write kind 2, which meets only kind 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entries, kinds, ids, ns, ks, ats, facts = [], [], [], [], [], [], []

            def put(values: np.ndarray, kind: int, i: int, n: int, k: int, at: np.ndarray) -> None:
                entries.append(values)
                kinds.append(np.full(len(values), kind, np.int32))
                ids.append(np.full(len(values), i, np.int64))
                ns.append(np.full(len(values), n, np.int64))
                ks.append(np.full(len(values), k, np.int32))
                ats.append(at.astype(np.int32))

            for i, n, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                tokens, counts = np.frombuffer(t, np.uint64), np.frombuffer(c, np.int32)
                at = mix(tokens)
                parity = np.zeros(BITMAP, np.uint64)
                np.bitwise_xor.at(parity, (at % np.uint64(BITMAP)).astype(np.int64), np.uint64(1) << (at >> np.uint64(58)))
                written, total = len(ns), len(tokens)
                prefix = len(tokens) - int(needed(n, 1)) + 2
                tokens, counts = tokens[:prefix], counts[:prefix]
                rare = counts <= FREQUENT
                where = np.arange(len(tokens))
                put(tokens[rare], 0, i, n, 1, where[rare])
                frequent, where = tokens[~rare], where[~rare]
                if len(frequent) > MOST_PAIRED:
                    put(frequent, 1, i, n, 1, where)
                elif len(frequent):
                    put(frequent, 2, i, n, 1, where)
                    x, y = np.triu_indices(len(frequent), 1)
                    put(_joined(frequent[x], frequent[y]), 0, i, n, 2, where[y])
                facts.append(np.tile(np.r_[np.int64(total), parity.view(np.int64)], (sum(map(len, ns[written:])), 1)))
            flat = (lambda a, kind: np.concatenate([np.zeros(0, kind), *a]).astype(kind))
            numbers = np.ascontiguousarray((np.concatenate(facts) if facts else np.zeros((0, BITMAP + 1), np.int64)).T)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat(entries, np.uint64).view(np.int64)), pa.array(flat(kinds, np.int32)), pa.array(flat(ids, np.int64)), pa.array(flat(ks, np.int32)), pa.array(flat(ats, np.int32)), pa.array(flat(ns, np.int64)), *map(pa.array, numbers)],
                names=ENTRY,
            )

    return counted.mapInArrow(trimmed(run), ENTRY_SCHEMA)


ENTRY = ["entry", "kind", "id", "k", "at", "n", "s", *BITS]
ENTRY_SCHEMA = "entry long, kind int, id long, k int, at int, n long, s long, " + ", ".join(f"{b} long" for b in BITS)


def _joined(entry: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The entry of a combination and one more token."""
    return mix(entry * np.uint64(0x9E3779B97F4A7C15) ^ (token + (entry >> np.uint64(7))))


def divided(entries: DataFrame, counted: DataFrame) -> DataFrame:
    """The entries of each combination with one more token behind its last, from the prefix extended by one.

    Partners whose least ``k`` shared tokens are the entry's share one more, if
    they share more than ``k`` at all; it lies behind ``at`` in both prefixes
    of length s - needed(n) + k + 1.  Documents that may share no more also
    write an entry of their own kind of combination, where they meet each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, value = [], []
            old = b.column("entry").to_numpy().view(np.uint64)
            for r, (n, k, at, t) in enumerate(zip(b.column("n").to_pylist(), b.column("k").to_pylist(), b.column("at").to_pylist(), b.column("tokens"), strict=True)):
                tokens = np.frombuffer(t.as_buffer(), np.uint64)
                least = int(needed(n, 1))
                more = np.arange(at + 1, min(len(tokens), len(tokens) - least + k + 1))
                made = _joined(np.full(len(more), old[r]), tokens[more])
                if least <= k:
                    more, made = np.r_[more, at], np.r_[made, _joined(old[r : r + 1], np.zeros(1, np.uint64))]
                row.append(np.column_stack([np.full(len(more), r), more]))
                value.append(made)
            where = np.concatenate([np.zeros((0, 2), np.int64), *row])
            out = b.select(ENTRY).take(pa.array(where[:, 0]))
            columns = dict(zip(ENTRY, out.columns))
            columns["entry"] = pa.array(np.concatenate([np.zeros(0, np.uint64), *value]).view(np.int64))
            columns["at"] = pa.array(where[:, 1].astype(np.int32))
            columns["k"] = pa.array(out.column("k").to_numpy() + np.int32(1))
            yield pa.RecordBatch.from_arrays([columns[c] for c in ENTRY], names=ENTRY)

    return entries.join(counted.select("id", "tokens"), "id").mapInArrow(trimmed(run), ENTRY_SCHEMA)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets are similar enough; ``sets``: (id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, own = [], None, None
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if a != last:
                    last, own = a, np.frombuffer(x.as_buffer(), np.uint64)
                other = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                same = int((own[at] == other).sum())
                if DEN * same >= NUM * (len(own) + len(other) - same):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    left = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    right = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def whole_sets(texts: DataFrame) -> DataFrame:
    """Rows ``(id, tokens)`` with the packed sorted set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_binary, shingle_sets(part.column(1), WORDS)), pa.binary())], names=["id", "tokens"])

    return texts.mapInArrow(trimmed(run), "id long, tokens binary")


class _Links:
    """Links found so far, and the component labels that they make."""

    def __init__(self, texts, counted: DataFrame):
        self.texts, self.counted, self.sets, self.links, self.known = texts, counted, None, None, None

    def unsettled(self, entries: DataFrame) -> DataFrame:
        """The entries that hold documents of two components which may be compared there, with each document's ``label``."""
        own = entries.withColumn("label", F.col("id"))
        if self.known is not None:
            own = entries.join(self.known, "id", "left").withColumn("label", F.coalesce("label", "id"))
        mixed = own.groupBy("entry").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("kind").alias("k")).where("x <> y and k < 2").select("entry")
        return durable(own.join(mixed, "entry", "left_semi"), "open-entries")

    @staticmethod
    def merged(own: DataFrame) -> DataFrame:
        """Entries with the same members are one, so that pairs that share a passage meet once and not at each of its tokens.

        Of the merged combinations the longest and the place of the first hold.
        """
        members = [F.bit_xor(F.xxhash64("id", "kind", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
        sign = durable(own.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), *members), "signatures")
        same = sign.groupBy("members", "x1", "x2").agg(F.min("entry").alias("_first"))
        known = sign.join(same, ["members", "x1", "x2"]).select("entry", "_first")
        alike = ["kind", "id", "n", "s", *BITS, "label"]
        return own.join(known, "entry").groupBy(F.col("_first").alias("entry"), *alike).agg(F.min("at").alias("at"), F.max("k").alias("k"))

    @staticmethod
    def size_pairs(own: DataFrame) -> DataFrame:
        """Rows ``(entry, kind, n, hub_kind, m, ..)``: pairs of set sizes of which an entry has members that may be linked there.

        ``own`` has each member's ``room``; with the lowest and highest label of both sizes. Pairs of one kind are there once.
        """
        sizes = own.groupBy("entry", "kind", "n").agg(F.max("room").alias("room"), F.min("label").alias("low"), F.max("label").alias("high"))
        other = sizes.where("kind < 2").toDF("entry", "hub_kind", "m", "hub_room", "hub_low", "hub_high")
        fits = (F.col("m") * NUM <= F.col("room")) & (F.col("n") * NUM <= F.col("hub_room")) & (F.col("n") * NUM <= F.col("m") * DEN) & (F.col("m") * NUM <= F.col("n") * DEN)
        mixed = F.least("low", "hub_low") < F.greatest("high", "hub_high")
        pairs = sizes.join(other, "entry").where(fits & mixed & _Links.roles() & ((F.col("kind") != F.col("hub_kind")) | (F.col("n") <= F.col("m"))))
        return durable(pairs.drop("room", "hub_room"), "size-pairs")

    def meet(self, own: DataFrame, number: int, most: int | None, single: bool) -> None:
        """Compare the documents of each entry with its hubs, or with all members whose set sizes can match theirs."""
        # Two sets must share NUM / (NUM + DEN) of n + m, and can share the smaller s at most; if a combination is the least
        # that they share, only what it holds and what lies behind it. What is left to a member is NUM times a partner's size.
        room = F.least(F.col("s"), F.col("s") - F.col("at") + F.col("k") - 1) * (NUM + DEN) - F.col("n") * NUM
        own = own.withColumn("room", room)
        hubs = own.where("kind < 2")
        if most is not None:
            # The least of each slice of an entry, by component, so that a large component's member is met first; no task sorts a whole entry.
            cell = F.pmod(F.xxhash64("id", F.lit(number)), F.lit(most))
            hubs = hubs.groupBy("entry", cell.alias("cell")).agg(F.min(F.struct("label", "id", "n", "kind", "s", "room", *BITS)).alias("hub")).select("entry", "hub.*")
        hubs = hubs.select("entry", F.col("id").alias("hub"), F.col("n").alias("m"), F.col("kind").alias("hub_kind"), F.col("label").alias("hub_label"), F.col("s").alias("hub_s"), F.col("room").alias("hub_room"), *(F.col(b).alias(f"hub_{b}") for b in BITS))
        near, far = F.col("m") * NUM <= F.col("room"), F.col("n") * NUM <= F.col("hub_room")
        fits = near & far & (F.col("n") * NUM <= F.col("m") * DEN) & (F.col("m") * NUM <= F.col("n") * DEN)
        on, twice = ["entry"], F.lit(False)
        if most is None:
            # Members meet by pairs of sizes, each only at sizes that it has room for; the sizes in an entry are few, its members may be many.
            on, pairs = ["entry", "kind", "n", "hub_kind", "m"], self.size_pairs(own)
            own = own.join(pairs.select(*on, "hub_low", "hub_high"), on[:3]).where(near & ((F.col("hub_low") != F.col("label")) | (F.col("hub_high") != F.col("label"))))
            hubs = hubs.join(pairs.select(*on, "low", "high"), ["entry", "hub_kind", "m"]).where(far & ((F.col("low") != F.col("hub_label")) | (F.col("high") != F.col("hub_label"))))
            twice = (F.col("kind") == F.col("hub_kind")) & (F.col("n") == F.col("m")) & (F.col("id") > F.col("hub"))
        apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"hub_{b}"))) for b in BITS), F.lit(0))
        # Twice the shared tokens are at most s + hub_s - apart, and at least twice NUM / (NUM + DEN) of n + m.
        enough = (F.col("s") + F.col("hub_s") - apart) * (NUM + DEN) >= (F.col("n") + F.col("m")) * (2 * NUM)
        met = own.join(hubs, on).where((F.col("label") != F.col("hub_label")) & fits & self.roles() & ~twice & enough)
        if single:
            first = F.min(F.struct("hub_label", F.xxhash64("hub", "id"), "hub")).alias("first")
            met = met.groupBy("id").agg(first).select("id", F.col("first.hub").alias("hub"))
        pairs = durable(met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "candidates")
        if pairs.isEmpty():
            return
        if self.sets is None:
            self.sets = durable(whole_sets(self.texts(self.counted.select("id"))), "sets", "uncompressed")
        found = durable(verify(pairs, self.sets), "links")
        self.links = found if self.links is None else self.links.unionAll(found)
        self.known = durable(components(self.links), "labels")

    @staticmethod
    def roles():
        return (F.col("kind") < 2) & (F.col("kind") == F.col("hub_kind")) | (F.col("kind") == 2) & (F.col("hub_kind") == 1)


def linked(texts, counted: DataFrame) -> DataFrame | None:
    """Component labels ``(id, label)`` of the classes that verified links connect; None without links.

    ``texts`` gives the rows (id, text) of a table of class numbers.
    """
    state, entries = _Links(texts, counted), durable(index_entries(counted), "entries")
    for number, (most, single) in enumerate(ROUNDS):
        own = state.unsettled(entries)
        if own.isEmpty():
            return state.known
        state.meet(own, number, most, single)
    for depth in range(DIVISIONS + 1):
        own = durable(state.merged(state.unsettled(entries)), "merged-entries")
        if own.isEmpty():
            break
        least = F.ceil(F.col("n") * NUM / DEN)
        rows = F.greatest(F.col("s") - least + F.col("k") - F.col("at"), F.lit(0)) + F.when(least <= F.col("k"), 1).otherwise(0)
        sizes = own.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), F.sum(rows).alias("rows"))
        large = sizes.where((F.col("members") > LARGE) & (F.col("rows") * PAIRS_A_ROW < F.col("members") * F.col("members"))).select("entry")
        large = durable(large if depth < DIVISIONS else large.limit(0), "large-entries")
        state.meet(own.join(large, "entry", "left_anti"), -1, None, False)
        if large.isEmpty():
            break
        entries = durable(divided(own.join(large, "entry", "left_semi").select(*ENTRY), counted), "divided")
        for number, (most, single) in enumerate(ROUNDS[1:], 1):
            own = state.unsettled(entries)
            if own.isEmpty():
                return state.known
            state.meet(own, number + 10 * depth, most, single)
    return state.known


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(doc_id, place, n, component, first)``: the number of each row's component, null for an empty set, and its first class."""
    bounded_batches(docs.sparkSession)
    with temporary(docs.sparkSession) as scope:
        keyed = durable(document_keys(docs, id_col, text_col), "keys")
        own = _components(docs, keyed, id_col, text_col)
        scope.keep(keyed, own)
    return keyed.join(own, ["k1", "k2", "n"], "left")


def _components(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(k1, k2, n, component, first)``, one for each class; a written table."""
    classes = classes_of(keyed)
    total = classes.agg(F.sum("n")).first()[0] or 0
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def parts(tokens: float) -> int:
        return int(max(2 * shuffles, tokens / PART_TOKENS))

    def texts(ids: DataFrame) -> DataFrame:
        return pick(docs, classes.join(ids.select(F.col("id").alias("class")), "class", "left_semi"), id_col, text_col)

    # Rows that share a key only add to what seems shared: all of their classes go on to the second pass.
    first = first_texts(docs, keyed, classes, id_col, text_col)
    sharing = token_counts(first, parts(total * HEAD_SHARE), HEAD_SHARE).select(F.col("id").alias("place")).distinct()
    some = durable(classes.join(sharing, "place", "left_semi").select(F.col("class").alias("id"), "n"), "sharing")
    rest = some.agg(F.sum("n")).first()[0] or 0
    labels = None
    if rest:
        counted = durable(token_counts(texts(some), parts(rest), 1.0), "counted", "uncompressed")
        labels = linked(texts, counted)
    own = classes.withColumn("component", F.col("class"))
    if labels is not None:
        own = classes.join(labels.select(F.col("id").alias("class"), "label"), "class", "left").withColumn("component", F.coalesce("label", "class"))
    own = durable(own.select("k1", "k2", "n", "doc_id", "place", "component"), "class-labels")
    # Most components are one class; the first rows of the others are a small table, so a large component stays spread.
    row = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "place")
    starts = own.groupBy("component").agg(F.min(row).alias("start"), F.count(F.lit(1)).alias("members")).where("members > 1").select("component", "start")
    out = own.join(few(durable(starts, "starts")), "component", "left").withColumn("first", F.coalesce("start", row))
    return durable(out.select("k1", "k2", "n", "component", "first"), "components")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id``.

    Two documents link when the Jaccard similarity of their shingle sets is at
    least 3/4; ``component_id`` is the smallest identifier reachable by links,
    null if all of them are null.  A text with fewer than five words is one
    shingle; null texts and texts without words have empty sets, link with
    nothing and are their own component.  Rows that repeat, share an identifier
    or have none link like any others and each get a row.  An empty table gives
    no rows.  Other columns are not read.
    """
    out = _labelled(docs, id_col, text_col)
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component of :func:`jaccard_components`, with all its columns.

    The row with the smallest identifier stays, null ones last; of rows that
    share it, the one whose text hashes lowest; of equal texts, the least by
    the other columns.  Rows with empty sets link with nothing and all stay.
    """
    rows = durable(_labelled(docs, id_col, text_col).where("n > 0").select("doc_id", "place", "first"), "labelled")
    same = F.col("place") == F.col("first.place")
    dropped = rows.where(~(same & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))).select("doc_id", "place")
    repeated = rows.where(same).groupBy("doc_id", "place").count().where("count > 1").select("doc_id", "place")
    return keep_rows(docs, dropped, repeated, id_col, text_col)
