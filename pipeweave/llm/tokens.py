"""Token ids by the tokenizers library, with the pieces of its own pre-tokenizer encoded once and kept.

For a byte-level BPE without normaliser, ids of a text are the ids of its pre-tokens in turn, so
each distinct pre-token is encoded by the library's model and kept in a cache of two generations
of about PIECE_BYTES each; only one that the cache lacks is looked at by itself. Pieces over LONGEST
characters are never kept. Texts holding an added token's string, and any other kind of tokenizer,
go to the library whole.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import sys
import threading
from array import array

import numpy as np

PIECE_BYTES, LONGEST = 56 << 20, 256
#: So many pieces of a text are looked up before the cache's size is checked.
_AT_ONCE = 1 << 14
_PLAIN = array("I").itemsize == 4 and sys.byteorder == "little"
#: The splitting pattern of the byte-level pre-tokenizer (a fixed value of the format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _splitters() -> tuple:
    """SPLIT's findall for any text, for texts without characters beyond the basic plane, and for ASCII.

    The latter two are for the standard library, which is faster, with SPLIT's classes spelled out.
    """
    import regex

    def spelled(last: int):
        known = "".join(chr(c) for c in range(last + 1) if not 0xD800 <= c < 0xE000)
        pattern = SPLIT.replace(r"\S", r"[^\s]")
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            ranges = "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{name}+", known))
            pattern = re.sub(rf"(\[[^]]*){re.escape(name)}", lambda m: m[1] + ranges, pattern)  # inside a class
            pattern = pattern.replace(name, f"[{ranges}]")
        return re.compile(pattern).findall

    return regex.compile(SPLIT).findall, spelled(0xFFFF), spelled(0x7F)


def _alphabet() -> str:
    """The byte-level alphabet by byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return "".join(chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256))


class _Pieces(dict):
    """Ids by piece; the encoder is asked for one that is missing."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, p: str) -> bytes:
        return self.encoder.piece(p)


class Encoder:
    """encode(text) -> little-endian uint32 ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            content = f.read()
        self.library = Tokenizer.from_str(content)
        self.model = self.library.model
        spec = json.loads(content)
        pre = spec.get("pre_tokenizer") or {}
        self.piecewise = (
            spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout") and not spec.get("truncation") and not spec.get("padding")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.split, self.split_basic, self.split_ascii = _splitters()
        self.alphabet = _alphabet()
        self.clear()

    def clear(self) -> None:
        """Empty the cache, so that an idle worker holds none."""
        self.cache, self.older = _Pieces(self), _Pieces(self)
        self.cache_bytes = 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def model_ids(self, p: str) -> bytes:
        """Ids of a pre-token."""
        spelled, _ = codecs.charmap_decode(p.encode(), "strict", self.alphabet)
        return _u4([t.id for t in self.model.tokenize(spelled)])

    def piece(self, p: str) -> bytes:
        """Ids of a pre-token that self.cache lacks."""
        ids = self.older.get(p) or self.model_ids(p)
        if len(p) <= LONGEST:
            self.cache[p] = ids
            self.cache_bytes += _size(p, ids)
        return ids

    def encode(self, text: str) -> bytes:
        if not self.piecewise or any(a in text for a in self.added):
            return self.whole(text)
        if text.isascii():
            pieces = self.split_ascii(text)
        else:
            basic = len(text.encode("utf-16-le")) == 2 * len(text)
            pieces = self.split_basic(text) if basic else self.split(text)
        out = []
        for i in range(0, len(pieces), _AT_ONCE):
            out.append(b"".join(map(self.cache.__getitem__, pieces[i : i + _AT_ONCE])))
            if self.cache_bytes > PIECE_BYTES:  # two generations: what is still in use moves over
                self.older, self.cache, self.cache_bytes = self.cache, _Pieces(self), 0
        return b"".join(out)


def _size(key: str, value: bytes) -> int:
    return sys.getsizeof(key) + sys.getsizeof(value) + 100  # and their place in a dictionary


def _u4(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _PLAIN else np.asarray(ids, "<u4").tobytes()


_local = threading.local()


def encoder(path: str) -> Encoder:
    """One encoder per worker and tokenizer file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    held = getattr(_local, "held", None)
    if held is None or held[0] != path:
        _local.held = held = (path, Encoder(path))
    return held[1]
