"""Token ids of whole texts from a byte-level tokenizer file, words in common encoded once.

The tokenizer splits a text into pieces and encodes each by itself, so a text's ids are its pieces' ids in turn.
A piece new to a worker goes straight to the library's model, in the characters that stand for its bytes, and is kept
up to a bound of pieces; beyond it, and where it is long, only until such pieces fill LATE_BYTES. Texts with special
strings, or with characters for which Python's pattern engine might split otherwise, go through the library whole.
A call takes texts of about TEXT_CHARS bytes, whatever the batch they come in.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 400_000
LONGEST_KEPT = 48
LATE_BYTES = 8 << 20
TEXTS_AT_ONCE, TEXT_CHARS = 1000, 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class _Held(dict):
    """Ids of pieces, as little-endian unsigned 32-bit integers; a piece not held is encoded."""

    def __init__(self, one: Callable[[str], bytes], most: int) -> None:
        self.one, self.most = one, most
        self.late: dict[str, bytes] = {}
        self.late_bytes = 0

    def __missing__(self, piece: str) -> bytes:
        x = self.late.get(piece)
        if x is None:
            x = self.one(piece)
            if len(self) < self.most and len(piece) <= LONGEST_KEPT:
                self[piece] = x
            else:
                if self.late_bytes > LATE_BYTES:
                    self.late.clear()
                    self.late_bytes = 0
                self.late[piece] = x
                self.late_bytes += 4 * len(piece) + len(x) + 150
        return x


def _splitter(letters: str, space: str) -> Callable[[str], list[str]]:
    """The byte-level tokenizer's split, for texts whose letters and white space are these and whose digits are ASCII."""
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{space}{letters}0-9]+|[{space}]+(?![^{space}])|[{space}]+").findall


class Encoder:
    def __init__(self, path: str, pieces: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.model._resize_cache(0)  # the pieces kept here are all that recur
        self.symbols = dict(enumerate(byte_symbols()))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.held = _Held(self._piece, CACHE_PIECES if pieces is None else pieces)
        # where classes of characters are known: ASCII, and the Latin letters with some marks
        self.ascii = _splitter("A-Za-z", r"\t-\r ")
        self.latin = _splitter("A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", r"\t-\r \xa0")
        self.plain = re.compile("[\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]*").fullmatch

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            known = piece.replace(" ", self.symbols[32])
        else:
            known = piece.encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(known)]).tobytes()

    def _split(self, text: str) -> list[str] | None:
        """A text's pieces; None where the library must split it."""
        split = self.ascii if text.isascii() else self.latin if self.plain(text) else None
        return None if split is None or any(s in text for s in self.special) else split(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        get = self.held.__getitem__
        return [self._whole(t) if (s := self._split(t)) is None else b"".join(map(get, s)) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str, pieces: int | None = None) -> Encoder:
    """One a worker process, whose tasks share it; it keeps at most so many pieces."""
    return Encoder(path, pieces)


def groups_of(batch: pa.RecordBatch, text: int, most: int = TEXTS_AT_ONCE, chars: int = TEXT_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts, in column `text`, have together at most so many bytes; one at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, (total[at - 1] if at else 0) + chars, "right"))
        to = min(max(to, at + 1), at + most, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]
