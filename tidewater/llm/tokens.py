"""Token ids of whole texts by the tokenizers library, one model call for each new word.

A BPE model never merges across the splits of its pre-tokenizer, so the ids of
a text are the ids of its pieces in turn.  A text is cut at ASCII white space,
where these tokenizers cut too; a piece made of plain letter, digit and
punctuation runs is cut at those as well and each run goes to the library's
model; every other piece, and every text whose white space is unusual, goes
through the library's whole pipeline.  Ids are packed as little-endian
unsigned 32-bit integers and kept in bounded caches.
"""

from __future__ import annotations

import gc
import os
import re
import struct

import numpy as np

#: Cut before a single space or around ASCII white space, as a byte-level pre-tokenizer does.
_SPACED = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")

#: White space beyond the ASCII set; such texts go to the library whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

#: Bytes without which a text has no other white space.
_OTHER_BYTES = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")

#: Spaces next to other white space, and white space beside spaces and line feeds.
_UNEVEN = (b"\t", b"\r", b"\x0b", b"\x0c", b"  ", b"\n\n", b"\n ", b" \n")

_END = ".,;:|!?#*$%&<>"

#: Marks that a run of letters never holds and that make one run by themselves.
_MARKS = b".,;:!?#*$%&>"

#: Packs so many ids; longer lists are rare.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(12)]

_PLAIN = re.compile(rb"( ?[A-Za-z]+)([.,;:!?#*$%&>]*)")

#: Entries of each cache in a worker, by treatment of spaces; when one is full, further pieces are encoded anew each time.
CACHE_PIECES = {"kept": 400_000, "dropped": 450_000}


class _Cache(dict):
    """Calls ``make`` for what it lacks and keeps the first ``most`` results, of those that are cheap to make anew the first half."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value, dear = self.make(key)
        if len(self) < (self.most if dear else self.most // 2):
            self[key] = value
        return value


class PieceEncoder:
    """Encodes texts to packed ids.

    ``spaces``: "dropped" if the tokenizer lowers case and removes white space
    between words and splits digits, "kept" if it is byte-level, case is kept
    and a leading space belongs to the word.
    """

    def __init__(self, path: str, spaces: str, most: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Strings of added tokens are found in the whole text before anything else; texts that may hold one go to the library.
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.model = self.tokenizer.model
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.kept = spaces == "kept"
        self.runs = re.compile(rb" ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+" if self.kept else rb"[a-z]+|[0-9]|[^a-z0-9]+")
        most = most or CACHE_PIECES[spaces]
        self.run_cache = _Cache(self._run, most)
        self.cache = _Cache(self._piece, most)
        self.after_space = _Cache(self._after, most)
        gc.freeze()  # the caches hold no cycles; a worker's collector need not walk them

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _run(self, run: bytes) -> tuple[bytes, bool]:
        text = run.decode()
        if text.isascii() and text.isprintable():  # the byte alphabet leaves these characters as they are, but for the space
            mapped = text.replace(" ", "Ġ")
        else:
            mapped = self.to_bytes.pre_tokenize_str(text)[0][0]
        return self._pack(mapped), True

    def _pack(self, mapped: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(mapped)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def _after(self, piece: bytes) -> tuple[bytes, bool]:
        """A piece that follows a space, or one that begins with a line feed; words with marks behind are put together anew each time."""
        if piece.isalpha():  # ASCII letters alone: one run, kept by this cache only
            return self._pack("Ġ" + piece.decode()), True
        if piece[:1] != b"\n":
            word = piece.rstrip(_MARKS)
            if word.isalpha():
                return self.after_space[word] + self.run_cache[piece[len(word) :]], False
            return self._piece(b" " + piece)
        return self.run_cache[b"\n"] + (self.cache[piece[1:]] if len(piece) > 1 else b""), False

    def _piece(self, piece: bytes) -> tuple[bytes, bool]:
        own = piece if self.kept else piece.lower()
        if own.isalpha():
            return (self._pack(own.decode()), True) if own == piece else (self.cache[own], True)
        if not self.kept and (word := own.rstrip(_MARKS)).isalpha():
            return self.cache[word] + self.run_cache[own[len(word) :]], True
        if m := _PLAIN.fullmatch(own):
            word, end = m.groups()
            first = self.run_cache[word] if self.kept else self.cache[word]
            return (first + self.run_cache[end], False) if end else (first, False)
        if own.isascii():
            if b"'" not in own and b"<|" not in own and (own.isalnum() or own.translate(None, b"\t\n\x0b\x0c\r") == own and own.strip(b" ")):
                return b"".join(map(self.run_cache.__getitem__, self.runs.findall(own))), True
            return self._library(piece.decode()), True
        text = own.decode()
        core = text.rstrip(_END)
        word = core[1:] if core[:1] == " " else core
        if word.isalpha() and max(word) < "ɐ" and "İ" not in word:  # Latin letters: lowering needs no context, and NFC leaves them
            word = core if self.kept else core.lower()
            if len(text) == len(core):
                return self.run_cache[word.encode()], True
            end = text[len(core) :]
            return self.run_cache[word.encode()] + (self._library(end) if "<|" in end else self.run_cache[end.encode()]), True
        return self._library(piece.decode()), True

    def encode_one(self, text: str | None) -> bytes:
        """Packed ids of a text; null counts as empty."""
        text = text or ""
        if any(a in text for a in self.added):
            return self._library(text)
        raw = text.encode()
        if not self.kept:
            return b"".join(map(self.cache.__getitem__, raw.split()))
        if any(x in raw for x in _OTHER_BYTES) and _OTHER_SPACE.search(text):
            return self._library(text)
        if any(x in raw for x in _UNEVEN):
            return b"".join(map(self.cache.__getitem__, _SPACED.findall(raw)))
        first, *rest = raw.replace(b"\n", b" \n").split(b" ")
        return (self.cache[first] if first else b"") + b"".join(map(self.after_space.__getitem__, rest))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        enabled = gc.isenabled()
        gc.disable()  # lists of short-lived token objects otherwise trigger collection after collection
        try:
            return [self.encode_one(t) for t in texts]
        finally:
            if enabled:
                gc.enable()


_encoders: dict[tuple[str, str, int | None], PieceEncoder] = {}


def encoder(path: str, spaces: str, most: int | None = None) -> PieceEncoder:
    """The Python worker's encoder for a vocabulary file, with caches of ``most`` entries."""
    key = (path, spaces, most)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]
