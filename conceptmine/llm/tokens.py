"""Token ids of byte-level BPE by the ``tokenizers`` library, with repeated pieces encoded once per worker.

Byte-level BPE splits a text into pieces (words, numbers, signs, white space) and encodes
each piece alone. The split is done for a whole batch at once; a piece's ids come from the
library's model the first time and from a bounded cache afterwards. Texts with characters
whose class may differ between Unicode versions, or with a special token's text, go
through the library as a whole. Ids are the library's in every case.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
from tokenizers import Tokenizer

from conceptmine.llm import vec

#: Pieces kept; the cache starts anew when it is full. It decides nothing but speed.
CACHE = 200_000
#: Latin, Greek, Cyrillic: the classes of these characters have not changed for long.
_KNOWN = 0x530
_LETTER, _NUMBER, _OTHER, _SPACE = 1, 2, 3, 4
#: White space in some definitions only.
_UNSURE = [0x1C, 0x1D, 0x1E, 0x1F, 0x85]


def _classes() -> np.ndarray:
    import unicodedata
    out = np.full(_KNOWN, _OTHER, np.int8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0xA0]] = _SPACE
    return out


_CLASS = _classes()
_VALUE = vec.scramble(np.arange(1, _KNOWN + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _byte_letters() -> np.ndarray:
    """The printable letter that stands for each byte in the model's vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    out = np.arange(256, dtype=np.uint32)
    out[rest] = 256 + np.arange(len(rest))
    return out


_LETTERS = _byte_letters()


def piece_starts(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, for known characters of texts that begin at ``offsets``.

    A run of letters, of numbers or of other signs is a piece, with one blank before it if
    there is one; of longer white space before a run the last character stands apart; an
    apostrophe and the letters of a contraction are a piece.
    """
    n = len(chars)
    if not n:
        return np.empty(0, np.int64)
    kind = _CLASS[chars]
    head = np.zeros(n + 1, bool)  # first character of a text; one more for the end
    head[offsets] = True
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    run = change | head
    space = kind == _SPACE
    begin = run[:n].copy()
    at = np.flatnonzero(run[:n] & ~space)  # runs that are no white space
    inner = at[~head[at]]
    after = inner[space[inner - 1]]
    blank = after[chars[after - 1] == 32]
    begin[after - 1] = True
    begin[blank] = False
    # contractions: a lone apostrophe without a blank, letters right behind it
    mark = at[(chars[at] == 39) & begin[at] & run[at + 1]]
    mark = mark[mark + 1 < n]
    mark = mark[~head[mark + 1] & (kind[np.minimum(mark + 1, n - 1)] == _LETTER)]
    if len(mark):
        one = chars[mark + 1]
        two = np.where((mark + 2 < n) & ~head[np.minimum(mark + 2, n)], chars[np.minimum(mark + 2, n - 1)], 0)
        size = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
        size[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        rest = mark + 1 + size
        inside = rest < n
        rest = rest[inside]
        begin[rest[(kind[rest] == _LETTER) & ~head[rest]]] = True
    return np.flatnonzero(begin)


class Encoder:
    """Ids of whole batches of texts."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self, room: int = CACHE) -> None:
        self.place: dict[int, int] = {}
        self.room = room
        self.begin, self.count = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _add(self, keys: list[int], pieces: list[str]) -> None:
        """Cache the ids of new pieces."""
        tokenize = self.model.tokenize
        lists = [[t.id for t in tokenize(p)] for p in pieces]
        slot = len(self.place)
        self.place.update(zip(keys, range(slot, slot + len(keys))))
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.begin[slot:slot + len(keys)] = self.used + np.cumsum(count) - count
        self.count[slot:slot + len(keys)] = count
        self.used += len(flat)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one entry more at the end)."""
        text = buf.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
        cuts = lead[offsets]
        unsure = (chars >= _KNOWN) | np.isin(chars, _UNSURE)
        whole = np.diff(np.r_[0, np.cumsum(unsure)][cuts]) > 0
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                whole[np.searchsorted(cuts, at, "right") - 1] = True
                at = text.find(s, at + 1)
        safe = np.where(unsure, np.uint32(63), chars) if unsure.any() else chars
        starts = piece_starts(safe, cuts)
        ends = np.r_[starts[1:], len(chars)] if len(starts) else starts
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_VALUE[safe] * vec.powers(vec._BASE, len(chars)), out=sums[1:])
        keys = vec.scramble((sums[ends] - sums[starts]) * vec.powers(vec._BASE_INVERSE, len(chars) + 1)[starts]
                            + (ends - starts).astype(np.uint64))
        first = np.searchsorted(starts, cuts)
        if whole.any():  # their pieces are not looked up
            use = ~whole[vec.owners(first)]
            starts, ends, keys = starts[use], ends[use], keys[use]
            first = np.r_[0, np.cumsum(use)][first]
        keys = keys.tolist()
        slots = np.array(list(map(self.place.get, keys, repeat(-1))), np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new) + len(self.place) > self.room and len(self.place):
            self._reset()
            new = np.arange(len(keys))
        if len(new):
            fresh = {keys[i]: i for i in new.tolist()}
            if len(fresh) > self.room:
                self._reset(len(fresh))
            at = np.fromiter(fresh.values(), np.int64, len(fresh))
            place = np.r_[np.flatnonzero((buf & 0xC0) != 0x80), len(buf)]
            letters = _LETTERS[buf].tobytes().decode("utf-32-le")
            self._add(list(fresh), [letters[a:b] for a, b in zip(place[starts[at]].tolist(), place[ends[at]].tolist())])
            slots[new] = np.array(list(map(self.place.get, [keys[i] for i in new.tolist()])), np.int64)
        count = self.count[slots]
        total = np.r_[0, np.cumsum(count)]
        at = np.repeat(self.begin[slots] - total[:-1], count) + np.arange(total[-1])
        ids = self.ids[at] if len(at) else np.empty(0, np.uint32)
        bounds = total[first]
        if not whole.any():
            return ids, bounds
        parts, sizes = [], []
        for t in range(len(offsets) - 1):
            own = ids[bounds[t]:bounds[t + 1]]
            if whole[t]:
                own = np.array(self.tokenizer.encode(text[cuts[t]:cuts[t + 1]], add_special_tokens=False).ids, np.uint32)
            parts.append(own)
            sizes.append(len(own))
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
