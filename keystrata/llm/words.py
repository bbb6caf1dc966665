"""Words, bounded caches and exact chunk-wise tokenisation for Python workers."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable

import pyarrow as pa

# ASCII separators of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_WORDS = bytes(32 if c in set(_SEPARATORS) else _LOWER[c] for c in range(256))


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_bytes(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(_TO_WORDS).split()


def spaced_bytes(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return utf8(text).translate(_LOWER).split()


class Recent(dict):
    """A bounded cache for ``map(cache.__getitem__, keys)``: two generations of at most ``limit`` entries.

    A key that is used again moves to the young generation; when that is full, the old one is dropped. Keys
    longer than ``LONGEST`` are not kept, so entries are small.
    """

    LONGEST = 128

    def __init__(self, make: Callable, limit: int = 250_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > self.LONGEST:
                return value
        if len(self) >= self.limit:
            self.old.clear()  # before the young ones are copied: never three generations
            self.old.update(self)
            self.clear()
        self[key] = value
        return value


def per_worker(name: str, make: Callable, version: str = ""):
    """One object in each Python worker process, kept from task to task while Spark reuses the worker.

    Another name or version takes its place, so a worker never holds the caches of several operators.
    Operators without caches of their own call ``release``, so that theirs is the worker's whole memory.
    """
    store = sys.modules.setdefault("_keystrata_worker", types.ModuleType("_keystrata_worker"))
    if getattr(store, "key", None) != (name, version):
        store.key = store.kept = None  # gone before the next one comes
        gc.collect()
        give_back()
        store.kept, store.key = make(), (name, version)
    return store.kept


def release() -> None:
    """Gives up what ``per_worker`` keeps, and the memory of it and of the tasks before, to the system."""
    store = sys.modules.get("_keystrata_worker")
    if store is not None and getattr(store, "kept", None) is not None:
        per_worker("", lambda: None)
    else:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, which glibc and Arrow's pool keep otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_level(text: str) -> str:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the other 68 follow from U+0100."""
    return text.encode().decode("latin-1").translate(_BYTE_LEVEL)


_ITSELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {c: 0x100 + i for i, c in enumerate(c for c in range(256) if c not in _ITSELF)}


class Chunks:
    """Tokenises whole texts exactly through a cache of chunks.

    The pre-tokenizers of both vocabularies never join characters across the boundaries used here: white
    space for ``spaced=False`` (white space has no tokens), the start of a white-space run for
    ``spaced=True`` (a run belongs to the word after it), and a letter followed by one of ``, . ; : ! ?``
    (a letter as the normalizer leaves it: some become a letter and a mark, which goes with what follows).
    Letters alone (after at most one space) are one pre-token, which goes straight to the library's model;
    any other chunk goes through the library's whole pipeline. Texts with special strings of the tokenizer, or
    with controls which Python alone takes for white space, go whole to the library. ``pack`` turns a list of
    ids into the cached value, ``join`` adds up such values; ``seed`` holds values of frequent chunks.
    """

    #: Four controls that Python takes for white space and the library does not.
    CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
    RUN = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str, spaced: bool, pack: Callable, join: Callable, seed: dict | None = None, limit: int = 350_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.pack, self.join = Tokenizer.from_file(path), spaced, pack, join
        self.tokenize, self.normalizer = self.tokenizer.model.tokenize, self.tokenizer.normalizer
        # Special strings are known by the signs before their first letter, for lower case may make one.
        added = [(re.match(r"\W*", x.content)[0], x.normalized) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = (*{signs for signs, _ in added}, *self.CONTROLS)
        self.whole = any(normalized or not signs for signs, normalized in added)  # nothing tells where they may be
        self.seed, self.inner, self.cache = seed or {}, Recent(self._inner, limit // 2), Recent(self._chunk, limit)

    def _encode(self, text: str):
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _inner(self, piece: str):
        word = piece[1:] if self.spaced and piece[0] == " " else piece
        if not word.isalpha() or len(piece) > 64:
            return self._encode(piece)
        if piece.isascii():
            piece = "\u0120" + word if word is not piece and len(word) < len(piece) else piece
        else:
            if self.normalizer and max(piece) < "\u0250" and "\u0130" not in piece:
                piece = piece.lower()  # composed already, and lower case is one letter for each
            elif self.normalizer:
                whole, piece = piece, self.normalizer.normalize_str(piece)
                if not piece.isalpha():  # lower case may add marks
                    return self._encode(whole)
            piece = byte_level(piece)
        return self.pack([token.id for token in self.tokenize(piece)])

    def _chunk(self, chunk: str):
        if self.seed and (value := self.seed.get(chunk)) is not None:
            return value
        if not self.spaced and chunk.isascii():
            chunk = chunk.lower()  # as the vocabulary's normalizer does
        elif self.spaced and chunk[0] == "\n" and chunk[1:2].isalpha():
            return self.join((self.inner["\n"], self._chunk(chunk[1:])))
        if len(chunk) > 64:
            return self._encode(chunk)
        if chunk[-1] in ",.;:!?" and chunk[-2:-1].isalpha() and self._ends_in_letter(chunk[:-1]):
            return self.join((self.inner[chunk[:-1]], self.inner[chunk[-1]]))
        return self.inner[chunk]

    def _ends_in_letter(self, piece: str) -> bool:
        """Whether a piece that ends in a letter still does once it is normalized."""
        if not self.normalizer or max(piece) < "\u0250" and "\u0130" not in piece:
            return True
        return self.normalizer.normalize_str(piece)[-1:].isalpha()

    def parts(self, text: str) -> Iterable:
        if self.whole or any(odd in text for odd in self.odd):
            return (self._encode(text),)
        if self.spaced:
            return map(self.cache.__getitem__, self.RUN.findall(text))
        try:  # in Latin-1, lower case is what the vocabulary's normalizer makes, letter by letter
            text.encode("latin-1")
        except UnicodeEncodeError:
            return map(self.cache.__getitem__, text.split())
        return map(self.cache.__getitem__, text.lower().split())

    def __call__(self, text: str | None):
        return self.join(self.parts(text or ""))


def id_bytes(ids: list[int]) -> bytes:
    """Token ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()
