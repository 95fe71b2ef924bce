"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams
predicts each bit of it, and the codeword with the least loss, bits weighed by
their reliability, names the language.  Close losses are flagged as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.kernels import LOWER, SPACE, bounded_batches, slices, text_bytes, trimmed
from tidewater.llm.toxicity import held_out

#: At most so many labelled texts are fitted, and of each language at most a share of them but no fewer than so many; they are chosen by hash,
#: and of each a piece of so many characters at a hashed place.  So many hash buckets of n-grams are features.
MAX_TEXTS, MIN_TEXTS, PIECE_CHARS, BUCKETS = 4000, 20, 8000, 4096

#: Least share of the best language over the next for a prediction that isn't ambiguous.
CLEAR = 0.2

UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """``n`` rows of -1 and 1: all splits up to 6 languages, else distinct seeded random columns."""
    if n <= 6:
        splits = [s for s in range(1, 1 << n) if s & 1 and s != (1 << n) - 1]
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], float).reshape(n, -1)
    rng = np.random.default_rng(7)
    width = int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(50):  # the draw whose closest rows are farthest apart
        m = np.where(rng.random((n, width)) < 0.5, -1.0, 1.0)
        m[:, np.abs(m.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        gap = min((width - m[i] @ m[:i].T).min() for i in range(1, n))
        if gap > most:
            best, most = m, gap
    return best


def buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the byte pair and of the byte triple that start at each byte; white space is one symbol, ASCII is lowered."""
    d = np.where(SPACE[data], 32, LOWER[data]).astype(np.uint32)
    d = np.r_[d, np.uint32(32), np.uint32(32)]
    two = d[:-2] << np.uint32(8) | d[1:-1]
    three = two << np.uint32(8) | d[2:]
    fold = lambda x, k: ((x * np.uint32(k)) >> np.uint32(20)).astype(np.int32)
    return fold(two, 2654435761), fold(three, 2246822519)


def starts(off: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` bytes start a pair and a triple inside their text; at a text's last two they don't."""
    own = np.ones(n, bool)
    size = off[1:] - off[:-1]
    own[off[1:][size > 0] - 1] = False
    own[off[1:][size > 1] - 2] = False
    return own


def features(texts: pa.Array) -> np.ndarray:
    """Times of each bucket in each text, over twice the text's bytes."""
    out = []
    for a, b in slices(texts):
        data, off = text_bytes(texts.slice(a, b - a))
        found, own = buckets(data), starts(off, len(data))
        for x, y in itertools.pairwise(off):
            v = np.zeros(BUCKETS, np.float32)
            for f in found:
                v += np.bincount(f[x:y][own[x:y]], minlength=BUCKETS)
            out.append(v / max(1.0, 2.0 * (y - x)))
    return np.array(out, np.float32).reshape(-1, BUCKETS)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Languages, codewords, a weight for each bucket and bit, biases and reliabilities.

    Every language with a text that is not held out is learned, from a bounded
    sample of pieces.  Rows without a text or language teach nothing.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_lang"))
    known = known.where(~held_out(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_t").isNotNull())
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    langs = sorted(counts)
    if len(langs) < 2:
        return {"langs": langs}
    # A language's share of the sample is its bound on the hash; the rows that pass are few, so they may meet in one task.
    most = {k: max(MIN_TEXTS, MAX_TEXTS // len(langs), MAX_TEXTS * n // sum(counts.values()) // 2) for k, n in counts.items()}
    bound = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(2**63 - 1, 2 * most[k] * 2**64 // n - 2**63))))
    hashed = known.withColumn("_h", F.xxhash64("_id", "_t")).where(F.col("_h") <= F.try_element_at(bound, F.col("_lang")))
    place = F.pmod(F.xxhash64("_t"), F.greatest(F.length("_t") - PIECE_CHARS, F.lit(1))).cast("int") + 1
    pieces = hashed.select("_lang", "_h", F.substring("_t", place, F.lit(PIECE_CHARS)).alias("_t"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_t"))
    limit = F.create_map(*(F.lit(x) for k in langs for x in (k, most[k])))
    rows = pieces.withColumn("_rank", rank).where(F.col("_rank") <= F.try_element_at(limit, F.col("_lang"))).orderBy("_lang", "_rank").select("_lang", "_t").collect()
    codes = codewords(len(langs))
    x = features(pa.array([r["_t"] for r in rows], pa.string()))
    scale = (1 / np.sqrt(np.maximum(x.mean(axis=0), 1e-6))).astype(np.float32)
    x *= scale
    place_of = {k: i for i, k in enumerate(langs)}
    y = codes[[place_of[r["_lang"]] for r in rows]].astype(np.float32)
    w, v, bias = np.zeros((BUCKETS, y.shape[1]), np.float32), 0, np.zeros(y.shape[1], np.float32)
    step = np.float32(4.0 / max(1e-6, float((x * x).sum(axis=1).mean())))
    for t in range(100):
        look = w + np.float32(t / (t + 3)) * v if t else w
        g = -y / (1 + np.exp(np.clip(y * (x @ look + bias), -30, 30))) / len(y)
        new = look - step * (x.T @ g + np.float32(1e-5) * look)
        bias -= np.float32(2.0) * g.sum(axis=0)
        v, w = new - w, new
    right = ((x @ w + bias > 0) == (y > 0)).mean(axis=0)
    return {"langs": langs, "codes": codes, "w": w * scale[:, None], "bias": bias, "reliable": np.clip(2 * right - 1, 0.05, 1)}


def margins(texts: pa.Array, model: dict) -> np.ndarray:
    """Margin of each bit for each whole text."""
    out = []
    for a, b in slices(texts):
        data, off = text_bytes(texts.slice(a, b - a))
        n = len(off) - 1
        full = np.flatnonzero(off[1:] > off[:-1])
        m = np.zeros((n, model["w"].shape[1]))
        if len(full):
            found, own = buckets(data), starts(off, len(data))
            for bit in range(m.shape[1]):
                column = np.ascontiguousarray(model["w"][:, bit])
                total = column[found[0]] + column[found[1]]
                m[full, bit] = np.add.reduceat(np.where(own, total, 0), off[:-1][full])
            m[full] /= 2.0 * (off[1:] - off[:-1])[full, None]
        out.append(m + model["bias"])
    return np.concatenate(out) if out else np.zeros((0, len(model["bias"])))


def decode(m: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest codeword, its share, and whether another is close."""
    each = np.logaddexp(0, -m[:, None, :] * model["codes"][None]) * model["reliable"]
    loss = each.sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    top = np.sort(share, axis=1)[:, ::-1]
    return best, top[:, 0], top[:, 0] - top[:, 1] < CLEAR


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, held_out, lang_pred, score, ambiguous``.

    A text that is null or has no letter is ``und`` with score 0; so is every
    text if no language was learned, and with one language all others are it.
    Repeated rows are predicted alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model["langs"], UNKNOWN], object)
        for b in batches:
            n = b.num_rows
            letters = np.array([any(map(str.isalpha, t or "")) for t in b.column(1).to_pylist()], bool)
            if len(langs) > 2:
                best, score, unclear = decode(margins(b.column(1), model), model)
            else:
                best, score, unclear = np.zeros(n, int), np.full(n, float(len(langs) - 1)), np.zeros(n, bool)
            best = np.where(letters, best, len(langs) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(langs[best].tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(unclear & letters)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return texts.mapInArrow(trimmed(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
