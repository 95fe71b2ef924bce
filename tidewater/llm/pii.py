"""Personal data: exact base patterns, and boosted trees over high-recall candidates.

Generators propose overlapping spans that look at all like an address, a
number, a card or a secret.  Gradient-boosted trees judge them by format and
context.  They are taught by planting into real texts: base spans of the corpus
rewritten into forms that the base patterns miss, and look-alikes that are
nobody's data.  A threshold for each kind, calibrated on texts that the trees
have not seen, selects the spans that are added to the base ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import bounded_batches, bounded_sample, slices, trimmed

#: Kinds of the base patterns, and all kinds in the order of lists.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

#: At most so many pieces of texts are fitted, one a text, chosen by hash, of at most so many characters; a quarter of them calibrate.
MAX_TEXTS, PIECE_CHARS = 1000, 1500

#: Planted spans in a piece.
PLANTED = 8

#: Precision that a kind's threshold keeps on the calibration pieces.
PRECISION = 0.99

#: Trees, their depth, the learning rate, and the number of cut points of a feature.
TREES, DEPTH, RATE, CUTS = 60, 4, 0.2, 16

#: Candidates judged at once.
BATCH_SPANS = 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of candidates; bounded repeats keep each linear in the text.
_AT = re.compile(r"\s?[(\[{<]\s?(?:at|AT|@)\s?[)\]}>]\s?|\s?@\s?")
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOT = r"(?:\.|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?)"
_AFTER_AT = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_WIDE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\s?[(\[]dot[)\]]\s?|[.,:])[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[./_ \-\u00a0]{0,3}[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:\+\s?\(?|00[ .-]?|\(0?|0)?[1-9][0-9\s()./\u2010-\u2015-]{5,19}[0-9](?![0-9A-Za-z])"),
}
_GIVEN = re.compile(r"\s?(?::=|=>|=|:)\s?[\"'`]?")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]{0,40}[\"']?\Z")
_VALUE = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/=_.-]{10,198}[A-Za-z0-9+/=_]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9_-]{20,200}(?![A-Za-z0-9+/=_-]|\.[A-Za-z0-9])")

#: Words in front of a span that speak for its kind, or against it.
_HINTS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile"),
    "secret": ("key", "token", "secret", "passw", "pwd", "auth", "credential", "bearer"),
}
_AGAINST = ("version", "commit", "sha", "md5", "hash", "checksum", "isbn", "order", "date", "digest", "uuid", "revision", "build", "time", "serial")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Found from each @ leftwards, so that a text without one costs a single search."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield ("email", start, m.end())
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """The base spans by kind, then start."""
    found = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += (("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15)
    return found


def candidates(text: str) -> list[Span]:
    """Overlapping spans of all generators."""
    out = []
    if "@" in text or "at" in text or "AT" in text:
        for m in _AT.finditer(text):
            left = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
            right = _AFTER_AT.match(text, m.end()) if left else None
            if right:
                out.append(("email", left.start(), right.end()))
    if _DIGIT.search(text):
        for kind, wide in _WIDE.items():
            for m in wide.finditer(text):
                if kind != "phone" or sum(map(str.isdigit, m[0])) <= (17 if m[0][:2] == "00" else 15):
                    out.append((kind, *m.span()))
    if "=" in text or ":" in text:
        for m in _GIVEN.finditer(text):
            if _NAME.search(text, max(0, m.start() - 42), m.start()) and (value := _VALUE.match(text, m.end())):
                out.append(("secret", *value.span()))
    given = {a for k, a, _ in out if k == "secret"}
    out += (("secret", *m.span()) for m in _TOKEN.finditer(text) if m.start() not in given)
    return out


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    own = text[a:b]
    groups = re.findall("[0-9]+", own)
    digits = "".join(groups)
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    context = text[max(0, a - 32) : a].lower()
    last = context[-18:]
    spread = np.unique(np.frombuffer(own.encode("utf-32-le"), np.uint32), return_counts=True)[1] / max(1, b - a)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in own)
    return [
        ALL_KINDS.index(kind), b - a, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(set(digits)), float(luhn(digits)) if digits else 0.0, max((int(g[-6:]) for g in groups), default=0),
        float(own[:1] == "+"), float(own[:2] == "00"), float(own[:1] == "("), own.count("."), own.count("-"), own.count(" "), own.count("("), own.count("["),
        own.count("/") + own.count(":") + own.count(","), float("dot" in own.lower()), float("at" in own.lower() and "@" not in own),
        float(before.isalnum()), float(before in ("\"", "'", "`")), float(after in ("\"", "'", "`")), float(before in ("=", ":")),
        float(any(h in last for h in _HINTS[kind])), float(any(h in last for h in _AGAINST)), float("=" in context[-4:]), float(":" in context[-4:]),
        float(-(spread * np.log2(spread)).sum()), hexes / (b - a), sum(map(str.isupper, own)) / (b - a), sum(map(str.islower, own)) / (b - a), float(own[-1:].isalnum()),
    ]


# Planting: what the trees learn from.


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _letters(r: np.random.Generator, n: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    return "".join(alphabet[i] for i in r.integers(0, len(alphabet), n))


def _with_luhn(digits: str, right: bool) -> str:
    tail = next(d for d in "0123456789" if luhn(digits[:-1] + d))
    return digits[:-1] + (tail if right else str((int(tail) + 3) % 10))


def _grouped(r: np.random.Generator, digits: str, marks: tuple[str, ...]) -> str:
    mark, cuts, at = str(r.choice(marks)), [], 0
    while at < len(digits):
        n = int(r.choice((4, 4, 3, 5, 6)))
        cuts.append(digits[at : at + n])
        at += n
    return mark.join(cuts)


HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def positive(r: np.random.Generator, pool: dict[str, list[str]]) -> tuple[str, str, str, str]:
    """``(kind, before, span, after)``: someone's data in a form that no base pattern finds; ``pool`` holds real base spans by kind."""
    kind = str(r.choice(ALL_KINDS))
    real = str(r.choice(pool[kind])) if pool.get(kind) else None
    lead = str(r.choice(["", "", "", *(h + " " for h in _HINTS[kind]), f"{_HINTS[kind][0]}: "]))
    if kind == "email":
        made = f"{_letters(r, int(r.integers(1, 9)))}{r.choice(['', '.', '_'])}{_digits(r, int(r.integers(1, 4)))}@{_letters(r, int(r.integers(1, 12)))}.{_letters(r, int(r.integers(2, 5)))}"
        name, _, host = (real if real and r.random() < 0.5 else made).rpartition("@")
        a, z = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("@", " (dot) "), (" AT ".join("()"), " DOT ".join("()")), ("[@]", "[.]"))[r.integers(8)]
        return kind, lead, name + a + host.replace(".", z), ""
    if kind == "ip":
        parts = (real or ".".join(map(str, r.integers(0, 256, 4)))).split(".")
        return kind, lead, str(r.choice(["[.]", "(.)", "[dot]", "(dot)", " [dot] "])).join(parts), ""
    if kind == "card":
        digits = re.sub("[^0-9]", "", real or "") or _with_luhn("4" + _digits(r, 15), True)
        return kind, lead, _grouped(r, digits, (".", "/", "_", " - ", "  ", "\u00a0")), ""
    if kind == "phone":
        digits = re.sub("[^0-9]", "", real or "") or str(r.integers(1, 99)) + _digits(r, 9)
        area, rest = digits[1:4], digits[4:]
        national = f"{rest[:3]}-{rest[3:]}"
        form = (f"00{digits[:1]} {area} {rest[:3]} {rest[3:]}", f"00{digits}", f"({area}) {national}", f"{area}-{national}", f"{area}.{rest[:3]}.{rest[3:]}", f"0{area}/{rest}", f"+ {digits[:1]} {area} {national}", f"+({digits[:1]}) {area} {national}", f"(0{area[:2]}) {rest[:3]} {rest[3:]}")[r.integers(9)]
        return kind, lead, form, ""
    name = str(r.choice(["api_key", "apikey", "secret", "token", "access_key", "password", "auth_token", "client_secret", "API_KEY", "SECRET_KEY", "db_password", "private_key", "session_token", "passwd"]))
    value = (_letters(r, int(r.integers(24, 65)), HEX), _letters(r, int(r.integers(16, 65)), ALNUM), _letters(r, int(r.integers(20, 44)), ALNUM + "+/"), "sk_live_" + _letters(r, 24, ALNUM), "ghp_" + _letters(r, 36, ALNUM))[r.integers(5)]
    opening, closing = (("\"", "\""), ("'", "'"), ("", ""))[r.integers(3)]
    return kind, name + str(r.choice([" = ", "=", ": ", ":", " => "])) + opening, value, closing


def look_alike(r: np.random.Generator) -> str:
    """What resembles personal data and is nobody's."""
    n = int(r.integers(0, 18))
    if n < 3:
        return _with_luhn(str(r.choice(["", "", "0", "00"])) + str(r.integers(1, 10)) + _digits(r, int(r.integers(12, 17))), False)
    if n == 3:
        return _grouped(r, _with_luhn(_digits(r, 16), False), (".", "/", " - ", "  ", " ", "-"))
    if n == 4:
        return f"{r.choice(['version ', 'v', 'release '])}{'.'.join(map(str, r.integers(0, 40, 4)))}"
    if n == 5:
        return str(r.choice(["commit ", "sha1 ", "hash ", "revision ", "", "blob "])) + _letters(r, int(r.choice([32, 40, 64])), HEX)
    if n == 6:
        return str(r.choice(["md5", "checksum", "sha256", "digest", "etag", "commit", "build", "uuid"])) + str(r.choice([" = ", ": ", "="])) + _letters(r, int(r.choice([32, 40, 64])), HEX)
    if n == 7:
        return f"{r.integers(1990, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}" + str(r.choice(["", " 10:30:00", "T08:15:59"]))
    if n == 8:
        return f"{r.integers(1, 29)}.{r.integers(1, 13)}.{r.integers(1990, 2030)}" + str(r.choice(["", f" - {r.integers(1, 29)}.{r.integers(1, 13)}.{r.integers(1990, 2030)}"]))
    if n == 9:
        return "-".join(_letters(r, k, HEX) for k in (8, 4, 4, 4, 12))
    if n == 10:
        return f"{r.choice(['name', 'title', 'class', 'file', 'path', 'url', 'note', 'lang'])}{r.choice([' = ', ': ', '='])}{_letters(r, int(r.integers(8, 16)))}{r.choice(['.', '_', '/', '-'])}{_letters(r, int(r.integers(5, 14)))}"
    if n == 11:
        return f"{r.integers(1, 999)},{_digits(r, 3)},{_digits(r, 3)},{_digits(r, 3)}"
    if n == 12:
        return f"{_digits(r, 4)} {_digits(r, 4)} {r.integers(1, 99)} {_digits(r, 3)} {r.choice(['units', 'items', 'rows'])}"
    if n == 13:
        return f"{r.choice(['isbn ', 'order ', 'serial ', 'no. '])}{_digits(r, 3)}-{_digits(r, 1)}-{_digits(r, 4)}-{_digits(r, 4)}-{_digits(r, 1)}"
    if n == 14:
        return "_".join(_letters(r, int(r.integers(4, 9))) for _ in range(int(r.integers(3, 6))))
    if n == 15:
        return f"{r.integers(1, 24)}:{_digits(r, 2)}:{_digits(r, 2)}:{_digits(r, 2)}"
    if n == 16:
        return f"{_letters(r, 5)}{r.choice([' @ ', '@', ' (at) ', ' [at] '])}{r.integers(1, 99)}.{_digits(r, 2)}"
    return f"{_letters(r, 4)} {r.choice(['[at]', '(at)', '@'])} {_letters(r, 3)}. {_letters(r, 6)}"


def planted(text: str, r: np.random.Generator, pool: dict[str, list[str]], n: int = PLANTED) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """``text`` with ``n`` planted spans between words: the new text, the spans that are data, and the places of look-alikes."""
    words = text.split(" ")
    places = np.sort(r.integers(0, len(words) + 1, n))
    out, at, length, good, bad = [], 0, 0, [], []
    for p in places:
        part = " ".join(words[at:p]) + " " if p > at else ""
        out.append(part)
        length += len(part)
        at = p
        if r.random() < 0.5:
            kind, before, span, after = positive(r, pool)
            good.append((kind, length + len(before), length + len(before) + len(span)))
            piece = before + span + after
        else:
            piece = look_alike(r)
            bad.append((length, length + len(piece)))
        piece += str(r.choice([" ", " ", ", ", ". ", "\n"]))
        out.append(piece)
        length += len(piece)
    return "".join(out) + " ".join(words[at:]), good, bad


def lessons(texts: list[str], seed: int = 0) -> tuple[list[tuple[str, Span]], np.ndarray, np.ndarray]:
    """Candidates in planted texts, whether each is someone's data, and the number of its text.

    Few texts are used several times, about MAX_TEXTS in all.  Candidates of
    the texts' own are left out, as nobody has labelled them.
    """
    pool: dict[str, list[str]] = {}
    for t in texts:
        for kind, a, b in base_spans(t):
            pool.setdefault(kind, []).append(t[a:b])
    found, y, own = [], [], []
    for n in range(len(texts) * max(1, MAX_TEXTS // max(1, len(texts)))):
        i = n % len(texts)
        new, good, bad = planted(texts[i], np.random.default_rng((seed, n)), pool)
        right = set(good)
        near = sorted([(a, b) for _, a, b in good] + bad)
        for span in candidates(new):
            if any(span[1] < b and a < span[2] for a, b in near):
                found.append((new, span))
                y.append(float(span in right))
                own.append(i)
    return found, np.array(y), np.array(own, int)


class Trees:
    """Gradient boosting for the log loss with exact cuts at quantiles."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1])) for j in range(x.shape[1])]
        self.trees = []
        f = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += RATE * self._value(tree, x)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray, depth: int):
        leaf = float(g[own].sum() / (h[own].sum() + 1.0))
        best, most = None, 1e-6
        if depth and len(own) >= 8:
            total = g[own].sum() ** 2 / (h[own].sum() + 1.0)
            for j, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                place = np.searchsorted(cuts, x[own, j], "left")
                gs, hs = (np.cumsum(np.bincount(place, v[own], len(cuts) + 1)) for v in (g, h))
                gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - total
                k = int(gain.argmax())
                if gain[k] > most:
                    best, most = (j, cuts[k]), gain[k]
        if best is None:
            return leaf
        left = x[own, best[0]] <= best[1]
        return (*best, self._grow(x, g, h, own[left], depth - 1), self._grow(x, g, h, own[~left], depth - 1))

    def _value(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, cut, left, right = tree
        return np.where(x[:, j] <= cut, self._value(left, x), self._value(right, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + RATE * sum(self._value(t, x) for t in self.trees))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Trees, dict[str, float]] | None:
    """Trees and a threshold for each kind; None without texts.

    At most MAX_TEXTS pieces of PIECE_CHARS characters reach the driver: a
    bounded sample, chosen by hash.
    """
    bounded_batches(docs.sparkSession)
    full = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    start = F.pmod(F.xxhash64("t"), F.greatest(F.length("t") - PIECE_CHARS, F.lit(1))).cast("int") + 1
    chosen = bounded_sample(full, ["_id", "t"], MAX_TEXTS, [F.substring("t", start, F.lit(PIECE_CHARS)).alias("t")])
    return fit([r[0] for r in chosen])


def fit(texts: list[str]) -> tuple[Trees, dict[str, float]] | None:
    """Trees taught by planting into three quarters of ``texts``; the rest set the thresholds."""
    found, y, own = lessons(texts)
    fold = own % 4 == 0
    if not len(y) or len(set(y[~fold])) < 2:
        return None
    x = np.array([features(*f) for f in found])
    trees = Trees(x[~fold], y[~fold])
    p, t, kinds = trees.predict(x[fold]), y[fold], x[fold, 0]
    limits = {}
    for number, kind in enumerate(ALL_KINDS):
        mine = kinds == number
        order = np.argsort(-p[mine], kind="stable")
        ranked, right = p[mine][order], np.cumsum(t[mine][order])
        precise = np.flatnonzero((right >= PRECISION * np.arange(1, len(order) + 1)) & (ranked >= 0.5))
        # Halfway to the next candidate that would have to be let in as well, but not under one half.
        below = ranked[precise[-1] + 1] if len(precise) and precise[-1] + 1 < len(ranked) else 0.0
        limits[kind] = float(max(0.5, (ranked[precise[-1]] + below) / 2)) if len(precise) else 1.1
    return trees, limits


def added_spans(texts: list[str], bases: list[list[Span]], model: tuple[Trees, dict[str, float]] | None) -> list[list[Span]]:
    """For each text the candidates at or above their kind's threshold that overlap neither a base span nor a better candidate.

    All candidates of the texts are judged together; a text's marks of taken
    characters keep the work linear in its spans.
    """
    out: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return out
    todo: list[tuple[int, Span]] = []
    taken: dict[int, bytearray] = {}

    def judge() -> None:
        p = model[0].predict(np.array([features(texts[i], s) for i, s in todo]))
        for at in np.argsort(-p, kind="stable"):
            i, s = todo[at]
            if p[at] >= model[1][s[0]] and 1 not in taken[i][s[1] : s[2]]:
                out[i].append(s)
                taken[i][s[1] : s[2]] = b"\1" * (s[2] - s[1])
        todo.clear()

    for i, (text, base) in enumerate(zip(texts, bases, strict=True)):
        spans = candidates(text)
        if not spans:
            continue
        taken[i] = bytearray(len(text))
        for _, a, b in base:
            taken[i][a:b] = b"\1" * (b - a)
        todo += ((i, s) for s in spans if 1 not in taken[i][s[1] : s[2]])
        if len(todo) >= BATCH_SPANS:
            judge()
    if todo:
        judge()
    return [sorted(o, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2])) for o in out]


def find_spans(docs: DataFrame, model: tuple[Trees, dict[str, float]] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, base array<struct>, added array<struct>`` of (kind, start, end) in code points.

    Null and empty texts have no spans; repeated rows get the same ones; an
    empty table gives no rows.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 60 small trees and five numbers
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for whole in batches:
            for first, stop in slices(whole.column(1), 4 << 20):
                b = whole.slice(first, stop - first)
                texts = [t or "" for t in b.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(named, base), one), pa.array(map(named, more), one)], names=["doc_id", "base", "added"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return texts.mapInArrow(trimmed(run), f"doc_id {kind}, base {spans}, added {spans}")


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
