"""Token ids of whole texts by a public tokenizer file, with the ids of recurring words kept.

A byte-level BPE tokenizer first cuts a text into words, numbers, punctuation and white space, and never joins over
such a cut. Texts are cut where that is certain (a single space or newline between other characters), and every distinct
piece is encoded once.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np

FILE = "byte_bpe_50k.json"
#: Distinct pieces kept by a worker; beyond that it starts afresh.
KEEP = 1_200_000
#: Characters of a text handled at a time.
PART = 1 << 20

# Texts with any of these take the slower cut: white space beside white space, rarer white space, the mark used for cutting.
_ODD = ("  ", " \n", "\n ", "\n\n", "\x00", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000",
        *map(chr, range(0x2000, 0x200B)))
_MARKS = (",", ".")
_ZERO = np.zeros(1, dtype=np.int64)
_PLAIN = re.compile(r" ?\S+")
_CUT = re.compile(r"(?<=\S)(?= \S)")
_CUT_AFTER = re.compile(r"\S(?= \S)")


class Encoder:
    """Encodes texts as ``tokenizers`` does with add_special_tokens=False."""

    keep = KEEP

    def __init__(self, file: str = FILE):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = ids[0] if len(ids) == 1 else None
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.sizes, self.flat = array("q"), array("q"), array("I")

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if any(x in text for x in _ODD):
            return _CUT.split(text)
        return text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")

    @staticmethod
    def _parts(text: str):
        at = 0
        while len(text) - at > PART and (cut := _CUT_AFTER.search(text, at + PART)):
            yield text[at:cut.end()]
            at = cut.end()
        yield text[at:]

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces, many at a time with newlines between them, which no word joins."""
        # A comma or full stop behind a letter or digit is always cut off: word and mark are learnt apart.
        marked = [p for p in pieces if p[-1:] in _MARKS and p[-2:-1].isalnum() and p[-2] < "\u0250"]
        if marked:
            whole = set(marked)
            stems = dict.fromkeys([*(p[:-1] for p in marked), *_MARKS])
            self._learn([p for p in stems if p not in self.places and p not in whole])
            pieces = [p for p in pieces if p not in whole]
            at = np.array([self.places[x] for p in marked for x in (p[:-1], p[-1])], dtype=np.int64)
            ids, upto = self._gather(at)
            self._keep(marked, ids, np.concatenate([_ZERO, upto[1:-1:2]]))
        plain = list(map(_PLAIN.fullmatch, pieces))
        own = [p for p, fits in zip(pieces, plain) if not fits or self.newline is None]
        rest = [p for p, fits in zip(pieces, plain) if fits and self.newline is not None]
        for piece in own:
            self._keep([piece], np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=np.uint32),
                       _ZERO)
        for i in range(0, len(rest), 512):
            some = rest[i:i + 512]
            joint = np.array(self.tokenizer.encode_batch_fast(
                ["\n".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            between = joint == self.newline
            ends = np.flatnonzero(between)
            self._keep(some, joint[~between], np.concatenate([[0], ends - np.arange(len(ends))]))

    def _keep(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        self.places.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts.frombytes((starts + len(self.flat)).tobytes())
        self.sizes.frombytes(np.diff(starts, append=len(ids)).tobytes())
        self.flat.frombytes(ids.tobytes())

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and where each piece ends."""
        if len(self.places) > self.keep:
            self._clear()
        at = np.fromiter(map(self.places.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            self._learn(list(dict.fromkeys([pieces[i] for i in unknown])))
            at[unknown] = [self.places[pieces[i]] for i in unknown]
        return self._gather(at)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the kept pieces ``at``, end to end, and where each ends."""
        sizes = np.frombuffer(self.sizes, dtype=np.int64)[at]
        upto = np.cumsum(sizes)
        index = np.repeat(np.frombuffer(self.starts, dtype=np.int64)[at] - upto + sizes, sizes)
        index += np.arange(len(index))
        return np.frombuffer(self.flat, dtype=np.uint32)[index], upto

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n + 1 places where texts begin. ``end`` is appended to each text; null: empty."""
        found, sizes = [], []
        waiting: list[str] = []
        counts: list[int] = []
        tail = np.array([] if end is None else [end], dtype=np.uint32)

        def flush() -> None:
            if not counts:
                return
            ids, upto = self._encode_pieces(waiting) if waiting else (tail[:0], tail[:0])
            cuts = np.concatenate([[0], upto]).astype(np.int64)[np.cumsum([0, *counts])]
            if len(tail):
                found.append(np.insert(ids, cuts[1:], tail[0]))
            else:
                found.append(ids)
            sizes.extend((np.diff(cuts) + len(tail)).tolist())
            waiting.clear()
            counts.clear()

        for text in texts:
            if text and len(text) > PART:
                flush()
                parts = [self._encode_pieces(self._pieces(part))[0] for part in self._parts(text)]
                found.append(np.concatenate([*parts, tail]))
                sizes.append(len(found[-1]))
                continue
            pieces = self._pieces(text) if text else []
            waiting.extend(pieces)
            counts.append(len(pieces))
            if len(waiting) > 200_000:
                flush()
        flush()
        ids = np.concatenate(found) if found else tail[:0]
        return ids.astype(np.uint32, copy=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(file: str = FILE, keep: int = KEEP) -> Encoder:
    """The worker's encoder for a file; loaded once. ``keep``: distinct pieces kept."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    _encoders[file].keep = keep
    return _encoders[file]
