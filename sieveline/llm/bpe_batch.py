"""Byte-pair merging of many pretokens at once, for operators that only need ids fast.

Same ids as ``bpe.Vocabulary``. Texts are cut into pretokens as bytes, Arrow tells the distinct ones of a slice apart, and ids
are gathered in numpy; Python sees only words with bytes that need the tokenizer's own pattern. New pretokens merge together: in
every round each merges its pair of least rank, the leftmost of equal ones; all take the round together in numpy, and a
pretoken leaves when it has no pair to merge.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import CACHE_WORDS, PAIR, WIDE_SPACE, Vocabulary, folded
from .hashing import WHITE, slices
from .tools import no_collector

_NONE = np.int64(1 << 62)
_POSITION = np.int64(32)
#: Bytes of folded texts that are cut together; what a worker needs for it is some thirty times as much.
SLICE = 2 << 20

#: Kinds of bytes: white space, letters, digits, other signs, and those of words that the tokenizer's pattern must cut.
_BLANK, _LETTER, _DIGIT, _SIGN, _HARD = range(5)
_KIND = np.full(256, _HARD, np.uint8)
_KIND[33:127] = _SIGN
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[ord("A") : ord("Z") + 1] = _KIND[ord("a") : ord("z") + 1] = _LETTER
_KIND[ord("'")] = _HARD
_KIND[0xC3:0xCA] = _LETTER  # lead bytes of U+00C0 to U+027F; of these, up to U+024F all are letters but two
_KIND[0x80:0xC0] = _LETTER  # what follows a lead byte
_KIND[WHITE] = _BLANK

_wide_blanks = re.compile(f"[{WIDE_SPACE}]")


def normalised(text: str) -> str:
    """Folded as the tokenizer does, with a space for white space beyond ASCII."""
    text = folded(text)
    return text if text.isascii() else _wide_blanks.sub(" ", text)


def kinds(buf: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8."""
    kind = _KIND[buf]
    # U+00D7 and U+00F7 are signs, and from U+0250 on not all are letters
    at = np.flatnonzero((buf == 0x97) | (buf == 0xB7))
    kind[at[buf[at - 1] == 0xC3]] = _HARD
    at = np.flatnonzero(buf == 0xC9)
    kind[at[buf[np.minimum(at + 1, len(buf) - 1)] >= 0x90]] = _HARD
    return kind


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` from ``starts``, of ``sizes`` each, one after another."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return pool[:0]
    return pool[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


def _binary(letters: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of these sizes that lie end to end in ``letters``."""
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])


def _joined(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings end to end, and their sizes."""
    bounds = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8))[bounds[0] : bounds[-1]], np.diff(bounds)


class BatchEncoder:
    """Texts to little-endian unsigned 32-bit ids, with a memo of pretokens and of words that need the pattern."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        keys = np.array(list(vocab.ranks), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(vocab.ranks.values()), np.int64)[order]
        self.wholes = np.array(vocab.wholes, np.int64)
        self.first, self.last = np.array(vocab.first, np.int64), np.array(vocab.last, np.int64)
        # pairs of single bytes by table
        self.low = int(max(self.first.max(), self.last.max())) + 1
        self.table = np.full((self.low, self.low), _NONE, np.int64)
        a, b = self.keys >> PAIR, self.keys & ((1 << PAIR) - 1)
        small = (a < self.low) & (b < self.low)
        self.table[a[small], b[small]] = self.ranks[small]
        self._forget()

    def _forget(self) -> None:
        """An empty memo: strings, where their ids start in the pool, and how many they are."""
        self.known = pa.array([], pa.binary())
        self.start = self.size = np.empty(0, np.int64)
        self.pool, self.missed = np.empty(0, np.uint32), 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << PAIR | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens of these sizes that lie end to end in ``raw``: all ids end to end, and how many each has."""
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.empty(0, np.uint32), ends
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        rank = np.full(len(sym), _NONE, np.int64)
        rank[:-1] = self.table[sym[:-1], sym[1:]]
        rank[ends - 1] = _NONE
        which, starts = np.arange(len(sizes)), ends - sizes
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            best = np.minimum.reduceat(np.where(rank == _NONE, _NONE, rank << _POSITION | np.arange(len(rank))), starts)
            done = best == _NONE
            if done.any():
                stays = np.repeat(~done, sizes)
                left.append((which[done], sizes[done], sym[~stays].astype(np.uint32)))
                moved = np.cumsum(stays) - 1
                sym, rank, which, sizes, best = sym[stays], rank[stays], which[~done], sizes[~done], best[~done]
                starts = np.cumsum(sizes) - sizes
                best = (best >> _POSITION) << _POSITION | moved[best & ((1 << 32) - 1)]
            if not len(which):
                break
            at = best & ((1 << 32) - 1)
            sym[at] = self.wholes[best >> _POSITION]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            shift = np.arange(len(which))
            sym, rank = sym[keep], rank[keep]
            starts, sizes, at = starts - shift, sizes - 1, at - shift
            inner = at + 1 < starts + sizes
            rank[at] = _NONE
            i = at[inner]
            rank[i] = self._rank(sym[i], sym[i + 1])
            i = at[at > starts]
            rank[i - 1] = self._rank(sym[i - 1], sym[i])
        which, sizes, ids = (np.concatenate([x[k] for x in left]) for k in range(3))
        order = np.argsort(which)
        return gathered(ids, (np.cumsum(sizes) - sizes)[order], sizes[order]), sizes[order]

    def _fresh(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens and words, as ``merge`` gives them."""
        raw, sizes = _joined(strings)
        if not len(strings):
            return np.empty(0, np.uint32), sizes
        hard = np.logical_or.reduceat(kinds(raw) == _HARD, np.cumsum(sizes) - sizes)
        if not hard.any():
            return self.merge(raw, sizes)
        split = self.vocab.split
        parts = [[s] if easy else [p.encode("utf-8", "surrogatepass") for p in split(s.decode("utf-8", "surrogatepass"))] for s, easy in zip(strings.to_pylist(), (~hard).tolist(), strict=True)]
        flat = pa.array([p for own in parts for p in own], pa.binary()).dictionary_encode()
        ids, sizes = self.merge(*_joined(flat.dictionary))
        at = flat.indices.to_numpy()
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        return gathered(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]), np.add.reduceat(sizes[at], np.cumsum(per) - per)

    def ids_of(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct strings: a pool of ids, and where each string's ids start and how many they are."""
        place = pc.index_in(strings, value_set=self.known)
        missing = pc.is_null(place).to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy()
        if not missing.any():
            return self.pool, self.start[place], self.size[place]
        new = strings.filter(pa.array(missing))
        ids, size = self._fresh(new)
        start = np.cumsum(size) - size + len(self.pool)
        pool = np.concatenate([self.pool, ids])
        starts, sizes = np.empty(len(strings), np.int64), np.empty(len(strings), np.int64)
        starts[missing], sizes[missing] = start, size
        starts[~missing], sizes[~missing] = self.start[place[~missing]], self.size[place[~missing]]
        # a full memo keeps what it has, which are the frequent ones, until it missed several times as many
        if len(self.known) + len(new) <= CACHE_WORDS:
            self.known, self.pool = pa.concat_arrays([self.known, new]), pool
            self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        else:
            self.missed += len(new)
            if self.missed >= CACHE_WORDS * 4:
                self._forget()
        return pool, starts, sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        with no_collector():
            return self._encode(texts)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        plain, special = [], {}
        for i, t in enumerate(texts):
            if t and "<|" in t and len(parts := list(self.vocab.pieces(t))) > 1:
                special[i] = parts
                plain.append(b"")
            else:
                plain.append(normalised(t or "").encode("utf-8", "surrogatepass"))
        out: list[bytes] = []
        for first, last in slices(plain, SLICE):
            out += self._slice(plain[first:last])
        for i, parts in special.items():
            # a special string stands between texts that are encoded by themselves
            between = self._encode([" ".join(words) for words, _ in parts])
            out[i] = b"".join(own + (b"" if code is None else code.to_bytes(4, "little")) for own, (_, code) in zip(between, parts, strict=True))
        return out

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        """Ids of normalised texts, in which only ASCII white space separates words."""
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = kinds(buf)
        blank = kind == _BLANK
        hard = np.flatnonzero(kind == _HARD)
        if len(hard):  # the whole word around
            edge = np.flatnonzero(blank)
            word = np.unique(np.searchsorted(edge, hard))
            begin = np.where(word > 0, edge[word - 1] + 1, 0)
            kind[gathered(np.arange(len(buf)), begin, edge[word] - begin)] = _HARD
        new = np.ones(len(buf), bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == _DIGIT
        edge = np.append(np.flatnonzero(new), len(buf))
        inside = ~blank[edge[:-1]]
        starts, sizes = edge[:-1][inside], np.diff(edge)[inside]
        if not len(starts):
            return [b""] * len(texts)
        coded = _binary(buf[~blank], sizes).dictionary_encode()
        pool, at, size = self.ids_of(coded.dictionary)
        which = coded.indices.to_numpy()
        per = size[which]
        data = gathered(pool, at[which], per).astype("<u4", copy=False)
        first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        upto = np.concatenate([[0], np.cumsum(per)])[first].tolist()
        return [data[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
