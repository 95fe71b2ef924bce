"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are its n-grams of lower-case bytes, across word ends
too, present or not, in hash buckets.  Each bucket is scaled by the log ratio
of its frequencies in toxic and other labelled texts; logistic regression
weighs them; folds of the fitted texts set penalty and bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import SLICE_BYTES, SPACE, bounded_batches, bounded_sample, distinct, mix, slices, text_bytes, trimmed

#: At most so many labelled texts of either class are fitted, chosen by hash, and of each a piece of so many characters at a hashed place.
MAX_PER_CLASS, PIECE_CHARS = 2000, 16_000

#: Lengths of n-grams in bytes, bits of a bucket's number; a bucket counts if it is in so many fitted texts and its log ratio is so large.
SIZES, BITS, MIN_TEXTS, MIN_RATIO, SMOOTHING = (5, 7), 21, 4, 2.0, 0.5

#: Penalties that the folds choose from, by what the model fitted to the other folds says of each.
PENALTIES, FOLDS = (3e-4, 1e-3), 3

#: Entries that are held before they are counted.
HELD = 4 << 20

#: Precision that the bias must keep for texts out of their fold.
PRECISION = 0.9

#: A model: buckets in ascending order, their weights and scales, and the bias.
Model = tuple[np.ndarray, np.ndarray, np.ndarray, float]


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the identifier as text is divisible by 5; a null identifier is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def gram_buckets(gram: bytes) -> int:
    """The bucket of one n-gram; white space is already one space."""
    h = np.zeros(1, np.uint64)
    for c in gram:
        h = h * np.uint64(0x100000001B3) + np.uint64(c)
    return int(mix(h + np.uint64(len(gram) << 57))[0] >> np.uint64(64 - BITS))


def bucket_hits(texts: pa.Array, wanted: np.ndarray | None = None, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For slices of ``texts``: pairs (text, bucket) of the n-grams that occur, once each, and the number of texts.

    White space counts as one space and so does a text's begin and end.  Only
    buckets with ``wanted`` are looked for.
    """
    for a, b in slices(texts, most):
        data, off = text_bytes(texts.slice(a, b - a))
        space = SPACE[data]
        first = np.zeros(len(data), bool)
        first[off[:-1][off[:-1] < off[1:]]] = True
        # The second and later white space of a run goes; each text gets a space in front, the last one also behind.
        keep = ~space | np.r_[True, ~space[:-1]] & ~first if len(data) else space
        kept = np.r_[0, np.cumsum(keep)][off]
        d = np.insert(np.where(space, 32, data)[keep], kept, 32).astype(np.uint64)
        begin = kept + np.arange(len(kept))
        n = b - a
        text = np.repeat(np.arange(n), np.diff(begin))
        left = np.repeat(begin[1:] + 1, np.diff(begin)) - np.arange(begin[0], begin[-1]) if n else np.zeros(0, np.int64)
        out = []
        h = np.zeros(len(d), np.uint64)
        for size in range(1, max(SIZES) + 1):
            h = h[: len(d) - size + 1] * np.uint64(0x100000001B3) + d[size - 1 :]
            if size not in SIZES or not len(h):
                continue
            bucket = (mix(h + np.uint64(size << 57)) >> np.uint64(64 - BITS)).astype(np.int64)
            m = min(len(bucket), len(text))
            hit = left[:m] >= size
            if wanted is not None:
                hit &= wanted[bucket[:m]]
            out.append(text[:m][hit] << BITS | bucket[:m][hit])
        found = distinct(np.concatenate([np.zeros(0, np.int64), *out]))
        yield found >> BITS, found & ((1 << BITS) - 1), n


def fit_logistic(row: np.ndarray, column: np.ndarray, x: np.ndarray, y: np.ndarray, m: int, l2: float, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-regularised logistic regression on entries (row, column, x); either class weighs one half."""
    n = len(y)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    u, curve = np.full(m, 1 / np.sqrt(max(1, m))), 0.0
    for _ in range(12):  # the largest curvature, by power iteration
        u = np.bincount(column, (np.bincount(row, u[column] * x, n) * weight)[row] * x, m)
        curve = float(np.linalg.norm(u))
        u /= max(curve, 1e-12)
    step = 1 / (0.3 * curve + 0.25)
    w, b, vw, vb = np.zeros(m), 0.0, np.zeros(m), 0.0
    for t in range(rounds):
        k = t / (t + 3)
        lw, lb = w + k * vw, b + k * vb
        g = (1 / (1 + np.exp(-np.clip(np.bincount(row, lw[column] * x, n) + lb, -30, 30))) - y) * weight
        nw = (lw - step * np.bincount(column, g[row] * x, m)) / (1 + step * l2)
        nb = lb - step * g.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def entries(texts: pa.Array, buckets: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (text, place in ``buckets``, value) of texts; a text's values have length 1."""
    wanted = np.zeros(1 << BITS, bool)
    wanted[buckets] = True
    rows, columns, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for text, bucket, n in bucket_hits(texts, wanted):
        rows.append(text + base)
        columns.append(np.searchsorted(buckets, bucket))
        base += n
    row, column = np.concatenate(rows), np.concatenate(columns)
    size = np.sqrt(np.bincount(row, scale[column] ** 2, base))
    return row, column, scale[column] / size[row]


def fit(texts: pa.Array, y: np.ndarray) -> Model:
    """The model of labelled texts: penalty and bias are the precise ones with the best F1 for texts out of their fold."""
    fold = np.arange(len(y)) % FOLDS
    count = np.zeros((2 * FOLDS, 1 << BITS), np.int32)
    group = (fold * 2 + (y > 0)).astype(np.int64)
    held: list[list[np.ndarray]] = [[] for _ in count]

    def add() -> None:
        for total, own in zip(count, held, strict=True):
            if own:
                total += np.bincount(np.concatenate(own), minlength=1 << BITS).astype(np.int32)
                own.clear()

    base = size = 0
    for text, bucket, n in bucket_hits(texts):
        of = group[base : base + n][text]
        for g, own in enumerate(held):
            own.append(bucket[of == g].astype(np.int32))
        base, size = base + n, size + len(bucket)
        if size >= HELD:
            add()
            size = 0
    add()
    count = count.reshape(FOLDS, 2, 1 << BITS)

    def chosen(folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.isin(fold, folds)
        neg, pos = count[folds].sum(axis=0)
        n = float((y[own] > 0).sum())
        ratio = np.log((pos + SMOOTHING) / (n + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (own.sum() - n + 2 * SMOOTHING))
        used = np.flatnonzero((pos + neg >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO))
        return used, ratio[used]

    margins = {l2: np.zeros(len(y)) for l2 in PENALTIES}
    for f in range(FOLDS):
        buckets, scale = chosen(np.flatnonzero(np.arange(FOLDS) != f))
        row, column, x = entries(texts, buckets, scale)
        learn = fold != f
        place = np.cumsum(learn) - 1
        own = learn[row]
        for l2, z in margins.items():
            w, b = fit_logistic(place[row[own]], column[own], x[own], y[learn], len(buckets), l2)
            z[~learn] = (np.bincount(row, w[column] * x, len(y)) + b)[~learn]
    # Without a precise cut, what undoes the equal weight of the classes.
    best, bias, penalty = 0.0, float(np.log(y.sum() / (1 - y).sum())), PENALTIES[0]
    for l2, z in margins.items():
        order = np.argsort(-z, kind="stable")
        hits, flagged = np.cumsum(y[order]), np.arange(1, len(y) + 1)
        f1 = np.where(hits >= PRECISION * flagged, 2 * hits / (flagged + y.sum()), 0.0)
        at = int(f1.argmax())
        if f1[at] > best:
            best, penalty = float(f1[at]), l2
            bias = -float((z[order[at]] + z[order[min(at + 1, len(y) - 1)]]) / 2)
    buckets, scale = chosen(np.arange(FOLDS))
    row, column, x = entries(texts, buckets, scale)
    w, b = fit_logistic(row, column, x, y, len(buckets), penalty)
    return buckets, w, scale, b + bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled texts that are not held out; of several labels of a document the largest holds.

    At most MAX_PER_CLASS pieces of texts of either class reach the driver.
    Without both classes nothing is learned and the bias follows the label that
    occurs.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).alias("_y"))
    few = [(r["_id"], y) for y in (False, True) for r in bounded_sample(known.where(F.col("_y") == y), ["_id"], MAX_PER_CLASS, ["_id"])]
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    if not few:
        return *none, -3.0
    kind = known.schema["_id"].dataType.simpleString()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(few, f"_id {kind}, _y boolean"))  # 2 * MAX_PER_CLASS rows
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    own = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).join(chosen, "_id")
    place = F.pmod(F.xxhash64("_t"), F.greatest(F.length("_t") - PIECE_CHARS, F.lit(1))).cast("int") + 1
    # Rows that share an identifier are one.
    rows = own.groupBy("_id", "_y").agg(F.min(F.substring("_t", place, F.lit(PIECE_CHARS))).alias("_t")).orderBy(F.xxhash64("_id"), "_id").collect()
    y = np.array([float(r["_y"]) for r in rows])
    if not len(y) or y.min() == y.max():
        return *none, (3.0 if len(y) and y[0] else -3.0)
    texts = pa.array([r["_t"] for r in rows], pa.string())
    del rows
    return fit(texts, y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted``; null and empty texts score the bias alone.

    Repeated rows score alike; an empty table gives no rows; other columns are
    not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS buckets, usually some thousands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights, scale, bias = shared.value
        for b in batches:
            row, column, x = entries(b.column(1), buckets, scale)
            z = np.bincount(row, weights[column] * x, b.num_rows) + bias if len(buckets) else np.full(b.num_rows, bias)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return texts.mapInArrow(trimmed(run), f"doc_id {kind}, held_out boolean, score double, predicted int")
