"""Tokenizing with a public byte-level BPE vocabulary, one word piece at a time.

The vocabulary's pre-tokenizer never lets a token cross the place before a
single space that stands between two non-space characters.  Texts are cut
there, and the ids of each piece are remembered per worker, so that only new
pieces are encoded.  New pieces go through ``tiktoken`` over the ranks of the
same vocabulary, which gives the ids of ``tokenizers`` several times faster
(tests compare both).  A special token's string is that token, and what stands
between two of them is encoded by itself.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: Pieces a worker remembers, about 200 bytes each.
CACHE_PIECES = 150_000
_TWO_SPACES = re.compile(r"\s\s")
_PLACES = re.compile(r"(?<=\S)(?= \S)")


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Path of the public vocabulary (without its ending)."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json").removesuffix(".json")


def pieces(text: str) -> list[str]:
    """Pieces whose tokens together are the text's tokens; they join to the text."""
    if _TWO_SPACES.search(text):
        return _PLACES.split(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [f" {p}" for p in rest]


class PieceTokenizer:
    """Encoder of whole texts; one per worker process."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(f"{path}.json", encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["id"]: t["content"] for t in added}
        self.id_of = {x: i for i, x in self.special.items()}
        # the longest first, where one begins with another
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.id_of, key=len, reverse=True))) + ")") if added else None
        with open(f"{path}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.body: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        return np.array(self.quick.encode_ordinary(piece), np.uint16).tobytes()

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian 16-bit integers."""
        if not text:
            return b""
        if self.marks and self.marks.search(text):
            parts = self.marks.split(text)  # every second part is a mark
            return b"".join(np.array([self.id_of[p]], np.uint16).tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))
        if len(self.known) + len(self.body) > CACHE_PIECES:
            self.known.clear()
            self.body.clear()
        if _TWO_SPACES.search(text):
            return b"".join(self._get(p) for p in _PLACES.split(text))
        first, *rest = text.split(" ")
        head = self._get(first) if first else b""
        body = self.body
        try:
            return head + b"".join(map(body.__getitem__, rest))
        except KeyError:
            for p in rest:
                if p not in body:
                    body[p] = self._new(" " + p)
            return head + b"".join(map(body.__getitem__, rest))

    def _get(self, piece: str) -> bytes:
        v = self.known.get(piece)
        if v is None:
            v = self.known[piece] = self._new(piece)
        return v


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)
