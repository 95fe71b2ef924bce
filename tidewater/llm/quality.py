"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are
compared with the references of the corpus's languages by Jensen-Shannon
distance.  The common words of a language are those that the corpus itself
shows to be common in it.  A document that is farther from every language than
the corpus's sound documents of its length are is rejected.  Short documents,
whose histograms say little, and documents of a language without a reference
are only held to the base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import SPACE, Words, bounded_batches, slices, trimmed, windows
from tidewater.llm.rows import keep_rows, row_key
from tidewater.plans.scratch import durable, temporary

#: A word is common in a language if it is at least this share of the runs of letters in its documents.
COMMON_SHARE = 0.005

#: Words of a language that a task holds before it reports, and a quarter of what it holds of all languages.
BLOCK_WORDS = 1_000_000

#: Character classes: lower case, upper case, digit, sentence mark, quote or bracket, symbol, line feed, other ASCII, beyond ASCII.
N_CLASSES = 9
CLASS = np.full(256, 7, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[[ord(c) for c in ".,;:!?-'"]] = 3
CLASS[[ord(c) for c in "\"()[]{}/_"]] = 4
CLASS[[ord(c) for c in "#*$%&|<>@^~+=\\`"]] = 5
CLASS[10] = 6
CLASS[0xC0:] = 8

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: What runs of letters are made of: letters, and any byte beyond ASCII.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False

#: Lengths below which a distance is not asked.
MIN_CHARS, MIN_WORDS = 200, 60

#: A distance is too large beyond the third quartile of sound documents of its length by so many times the quartiles' distance, or by so much.
CLASS_FENCE, CLASS_MARGIN = 16.0, 0.02
WORD_FENCE, WORD_MARGIN = 3.0, 0.05

#: Distances are counted in steps of one part in so many; a fence needs so many documents, else the next shorter length's holds.
STEPS, MIN_BAND = 10_000, 20

#: A language's reference needs so many documents, and so large a share of common words to be asked for words.
MIN_DOCS, MIN_LISTED = 20, 0.05

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [x.split()[0] for x in BASE.split(", ")]

_HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if _HAS_WORD.search(line):
            n += line in seen
            seen.add(line)
    return n


def repeated_words(h: np.ndarray, k: int = 8) -> int:
    """Words that lie in a ``k``-word window found twice or more."""
    w = windows(h, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w) + k, np.int32)
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    np.add.at(twice, at, 1)
    np.add.at(twice, at + k, -1)
    return int((np.cumsum(twice)[: len(h)] > 0).sum())


def measures(texts: pa.Array, listed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For slices of ``texts``: base counts, class histograms, and the number of letter runs, then pairs (number in ``listed``, times), of each."""
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        w, runs = Words(part), Words(part, NO_LETTER)
        exact, lower = w.hashes(lower=False), runs.hashes(lower=True)
        found = np.minimum(np.searchsorted(listed, lower), max(0, len(listed) - 1))
        known = listed[found] == lower if len(listed) else np.zeros(len(lower), bool)
        kinds = np.where(SPACE[w.data] & (w.data != 10), N_CLASSES, CLASS[w.data])
        kinds[(w.data >= 0x80) & (w.data < 0xC0)] = N_CLASSES  # later bytes of a code point
        chars = np.r_[0, np.cumsum((w.data < 0x80) | (w.data >= 0xC0))] - np.r_[0, np.cumsum(SPACE[w.data])]
        symbols = np.r_[0, np.cumsum(SYMBOL[w.data])]
        base, classes, common = [], [], []
        for i in range(len(w)):
            lo, hi, x, y = w.first[i], w.first[i + 1], w.off[i], w.off[i + 1]
            base.append((hi - lo, chars[y] - chars[x], symbols[y] - symbols[x], duplicate_lines(w.text(i)), repeated_words(exact[lo:hi])))
            classes.append(np.bincount(kinds[x:y], minlength=N_CLASSES + 1)[:N_CLASSES])
            lo, hi = runs.first[i], runs.first[i + 1]
            which, times = np.unique(found[lo:hi][known[lo:hi]], return_counts=True)
            common.append(np.r_[hi - lo, np.column_stack([which, times]).ravel()])
        yield np.array(base, np.int64).reshape(-1, len(NAMES)), np.array(classes, np.int64).reshape(-1, N_CLASSES), common


def base_failed(base: np.ndarray) -> np.ndarray:
    n, repeated = base[:, 0], base[:, 4]
    return (n < 20) | (100 * repeated > 30 * n)


def candidates(docs: DataFrame) -> dict[str, set[int]]:
    """For each language word hashes, as longs, among which all its common words are; ``docs``: (lang, text).

    A block of documents reports the words that are a quarter of
    COMMON_SHARE in it, so what a block leaves unsaid is less than that.  At
    most 4 / (3 * COMMON_SHARE) words of a language can pass, about 270.
    """
    least = COMMON_SHARE / 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def report(lang: str) -> pa.RecordBatch:
            words, times = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            total = size.pop(lang)
            often = times >= least * total
            n = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * (n + 1), pa.string()), pa.array([*words[often].view(np.int64).tolist(), None], pa.int64()), pa.array(np.r_[times[often], total]), pa.array(np.full(n + 1, total))],
                names=["lang", "word", "times", "total"],
            )

        for b in batches:
            for first, stop in slices(b.column(1)):
                runs = Words(b.column(1).slice(first, stop - first), NO_LETTER)
                h = runs.hashes(lower=True)
                langs = np.array(b.column(0).slice(first, stop - first).to_pylist(), object)
                of = np.repeat(np.arange(len(langs)), np.diff(runs.first))
                for lang in set(langs):
                    own = h[(langs == lang)[of]]
                    if len(own):
                        held.setdefault(lang, []).append(own)
                        size[lang] = size.get(lang, 0) + len(own)
                        if size[lang] >= BLOCK_WORDS:
                            yield report(lang)
                if sum(size.values()) >= 4 * BLOCK_WORDS:
                    for lang in sorted(held):
                        yield report(lang)
        for lang in sorted(held):
            yield report(lang)

    said = docs.mapInArrow(trimmed(run), "lang string, word long, times long, total long").groupBy("lang", "word").agg(F.sum("times").alias("times"), F.sum("total").alias("blocks"))
    said = durable(said, "common-words")
    totals = said.where("word is null").select("lang", F.col("times").alias("total"))
    # What the reporting blocks say, and less than a quarter of the share in all others.
    able = F.col("times") + least * (F.col("total") - F.col("blocks")) >= COMMON_SHARE * F.col("total")
    out: dict[str, set[int]] = {}
    for r in said.where("word is not null").join(F.broadcast(totals), "lang").where(able).select("lang", "word").collect():
        out.setdefault(r[0], set()).add(r[1])
    return out


class Reference:
    """A language: its common words' places in the list, and the distributions of its sound documents."""

    def __init__(self, lang: str, places: np.ndarray, classes: np.ndarray, words: np.ndarray):
        self.lang, self.places, self.classes, self.words = lang, places, classes, words

    @property
    def blind(self) -> bool:
        """Whether its common words are too rare to tell anything."""
        return 1 - self.words[-1] < MIN_LISTED


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of rows of counts ``p`` from the distribution ``q``; 0 for empty rows."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0)


def word_counts(common: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Dense counts of the words at ``places`` and, last, of all other letter runs."""
    out = np.zeros((len(common), len(places) + 1))
    for i, c in enumerate(common):
        if len(c) > 1 and len(places):
            at = np.minimum(np.searchsorted(places, c[1::2]), len(places) - 1)
            hit = places[at] == c[1::2]
            out[i, at[hit]] = c[2::2][hit]
        out[i, -1] = (c[0] if len(c) else 0) - out[i, :-1].sum()
    return out


def references(measured: DataFrame, listed: np.ndarray, of: dict[str, set[int]]) -> list[Reference]:
    """The languages with MIN_DOCS documents that pass the base rules and name them, most documents first.

    Words count as common by all documents of a language, and distributions
    are those of its sound ones.  What reaches the driver is one row for each
    language and candidate word.
    """
    named = measured.where("lang is not null")
    sound = (~F.col("base_failed")).cast("long")
    sums = named.groupBy("lang").agg(F.sum(sound).alias("docs"), F.sum(F.col("common")[0]).alias("runs"), F.sum(F.col("common")[0] * sound).alias("sound_runs"), *(F.sum(F.col("classes")[j] * sound).alias(f"c{j}") for j in range(N_CLASSES)))
    pairs = F.transform(F.sequence(F.lit(1), F.size("common") - 2, F.lit(2)), lambda i: F.struct(F.col("common")[i].alias("word"), F.col("common")[i + 1].alias("times")))
    each = named.where(F.size("common") > 1).select("lang", sound.alias("sound"), F.explode(pairs).alias("p"))
    words = each.groupBy("lang", "p.word").agg(F.sum("p.times").alias("times"), F.sum(F.col("p.times") * F.col("sound")).alias("sound_times"))
    facts = {r["lang"]: r for r in sums.where(F.col("docs") >= MIN_DOCS).collect()}
    common: dict[str, list] = {}
    own = words.join(F.broadcast(sums.select("lang", "runs")), "lang").where(F.col("times") >= COMMON_SHARE * F.col("runs"))
    for r in own.orderBy("lang", "word").collect():
        common.setdefault(r["lang"], []).append((r["word"], r["sound_times"]))
    out = []
    for lang, r in sorted(facts.items(), key=lambda x: (-x[1]["docs"], x[0])):
        mine = [(w, n) for w, n in common.get(lang, []) if int(listed[w : w + 1].view(np.int64)[0]) in of.get(lang, ())]
        places = np.array([w for w, _ in mine], np.int64)
        counts = np.array([*(n for _, n in mine), r["sound_runs"] - sum(n for _, n in mine)], float)
        classes = np.array([r[f"c{j}"] for j in range(N_CLASSES)], float)
        out.append(Reference(lang, places, classes / max(1, classes.sum()), counts / max(1, counts.sum())))
    return out


def measured_documents(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list[Reference]]:
    """Rows ``(doc_id, place, lang, base counts, base_failed, classes, common)``, written once, and the references."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col, lang_col).alias("place"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    of = candidates(texts.where("lang is not null").select("lang", "text"))
    listed = np.unique(np.array([w for words in of.values() for w in words], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for base, classes, common in measures(b.column(3), listed):
                part = b.slice(at, len(base))
                at += len(base)
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (classes, common)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c) for c in base.T), pa.array(base_failed(base)), *lists], names=["doc_id", "place", "lang", *NAMES, "base_failed", "classes", "common"])

    schema = f"doc_id long, place long, lang string, {BASE}, base_failed boolean, classes array<long>, common array<long>"
    measured = durable(texts.mapInArrow(trimmed(run), schema), "measured")
    return measured, references(measured, listed, of)


def with_distances(measured: DataFrame, refs: list[Reference]) -> DataFrame:
    """Add ``class_distance, word_distance``, to the nearest language, and whether each is ``asked_class``, ``asked_word``.

    Texts of a language without a reference are not asked: they may be far from
    all the others and yet be sound.  Texts of a language whose common words
    tell nothing are not asked for words, nor, if there is such a language,
    texts that name none.
    """
    known, blind = {None, *(r.lang for r in refs)}, {r.lang for r in refs if r.blind}
    telling = [r for r in refs if not r.blind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zero = np.zeros(b.num_rows)
            classes = np.array(b.column("classes").to_pylist(), float).reshape(-1, N_CLASSES)
            common = [np.array(c, np.int64) for c in b.column("common").to_pylist()]
            by_class = np.min([distance(classes, r.classes) for r in refs], axis=0) if refs else zero
            by_word = np.min([distance(word_counts(common, r.places), r.words) for r in telling], axis=0) if telling else zero
            langs, n_words = b.column("lang").to_pylist(), b.column("n_words").to_numpy()
            asked = np.array([x in known for x in langs], bool) & bool(refs)
            told = asked & np.array([x not in blind and not (x is None and blind) for x in langs], bool) & bool(telling)
            new = [pa.array(by_class), pa.array(by_word), pa.array(asked & (classes.sum(axis=1) >= MIN_CHARS)), pa.array(told & (n_words >= MIN_WORDS))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, *added])

    kept = ["doc_id", "place", *NAMES, "base_failed"]
    added = ["class_distance", "word_distance", "asked_class", "asked_word"]
    schema = f"doc_id long, place long, {BASE}, base_failed boolean, class_distance double, word_distance double, asked_class boolean, asked_word boolean"
    return measured.mapInArrow(trimmed(run), schema)


def band() -> Column:
    """The length of a text by powers of two of its words."""
    return F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int")


def fence(judged: DataFrame, name: str, times: float, margin: float) -> dict[int, float]:
    """For each length the largest distance that sound documents may have: quartiles of counted steps, exact whatever the partitions."""
    step = F.floor(F.col(f"{name}_distance") * STEPS).cast("int")
    counts = judged.where(~F.col("base_failed") & F.col(f"asked_{name}")).groupBy(band().alias("band"), step.alias("step")).count()
    found: dict[int, list] = {}
    for r in counts.orderBy("band", "step").collect():  # at most STEPS rows a band
        found.setdefault(r["band"], []).append((r["step"], r["count"]))
    out, last = {}, None
    for b in range(min(found, default=0), 64):
        steps = np.array(found.get(b, []), float).reshape(-1, 2)
        if steps[:, 1].sum() >= MIN_BAND:
            ends = np.cumsum(steps[:, 1])
            low, high = (steps[np.searchsorted(ends, q * ends[-1]), 0] / STEPS for q in (0.25, 0.75))
            last = float(high + max(margin, times * (high - low)))
        if last is not None:
            out[b] = last
    return out


def judged_documents(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Rows ``(doc_id, place, base counts, base_failed, kept, class_distance, word_distance)``."""
    with temporary(docs.sparkSession) as scope:
        measured, refs = measured_documents(docs, id_col, text_col, lang_col)
        judged = durable(with_distances(measured, refs), "distances")
        scope.keep(judged)
    far = F.lit(False)
    for name, times, margin in (("class", CLASS_FENCE, CLASS_MARGIN), ("word", WORD_FENCE, WORD_MARGIN)):
        limits = fence(judged, name, times, margin)
        if limits:
            limit = F.create_map(*(F.lit(x) for item in sorted(limits.items()) for x in item))
            # Lengths under all that have a fence are not judged.
            far |= F.col(f"asked_{name}") & F.coalesce(F.col(f"{name}_distance") > F.try_element_at(limit, band()), F.lit(False))
    return judged.select("doc_id", "place", *NAMES, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: ``doc_id``, the base counts, ``base_failed, kept, class_distance, word_distance``.

    Null and empty texts count nothing and fail the base rule; a null language
    gives no reference but is judged against all languages; repeated rows are judged
    alike; without any reference only the base rules decide.  An empty table
    gives no rows.  Other columns are not read.
    """
    return judged_documents(docs, id_col, text_col, lang_col).drop("place")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, columns unchanged, rows that repeat too.

    Rows alike in identifier, text and language share a verdict, which meets
    the texts again by their key.
    """
    rejected = judged_documents(docs, id_col, text_col, lang_col).where(~F.col("kept")).select("doc_id", "place")
    return keep_rows(docs, rejected, None, id_col, text_col, lang_col)
