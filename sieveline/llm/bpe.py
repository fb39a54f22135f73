"""BPE encoding and decoding (operator 3).

Each pretoken is a doubly linked list of symbols. A priority queue holds (merge rank, position, pair); the best pair
is merged, its neighbours are queued anew, and entries whose pair has changed since are skipped as stale. Decoding
concatenates vocabulary strings with one space between, as the tokenizer file names no decoder.

Nulls count as empty texts (no ids, both digests those of the empty string), a null doc_id is handed through. Any other column is
ignored; rows are independent, so repeated rows give equal rows, there are no ties, and an empty table gives no rows. Long texts go
through word by word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tools import no_collector, small

#: Words, and pretokens, whose encoding a worker remembers.
CACHE_WORDS = 400_000

#: The pretoken pattern and the white space of the tokenizer file.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WIDE_SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_SPACE = "\t-\r " + WIDE_SPACE

#: Widths of ids and of positions within packed numbers, and the first character that isn't in a Latin block.
PAIR, PLACE = 20, 40
PLACES = (1 << PLACE) - 1
LATIN_END = "\u0250"

_separators = re.compile(f"[{WHITE_SPACE}]+")
_odd_controls = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 in order."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class Memo(dict):
    """Results by word. A full memo keeps what it has, which are the frequent words, until it missed as often as it is large."""

    def __init__(self) -> None:
        self.missed = 0

    def keep(self, word: str, value: object) -> None:
        if len(self) >= CACHE_WORDS:
            self.missed += 1
            if self.missed < CACHE_WORDS * 4:
                return
            self.clear()
            self.missed = 0
        if len(word) <= 64:
            self[word] = value


    def keep_all(self, values: dict) -> None:
        """``keep`` for many words at once."""
        if len(self) + len(values) <= CACHE_WORDS:
            self.update({k: v for k, v in values.items() if len(k) <= 64})
        else:
            self.missed += len(values)
            if self.missed >= CACHE_WORDS * 4:
                self.clear()
                self.missed = 0


class Vocabulary:
    """A BPE tokenizer file of the kind "word ends marked by a suffix"."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[int, int] = {}  # pair, as left id << PAIR | right id, to rank
        self.wholes: list[int] = []  # rank to the merged id
        for rank, pair in enumerate(model["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.ids[x] << PAIR | self.ids[y], rank)
            self.wholes.append(self.ids[x + y])
        letters = byte_letters()
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.suffix] for c in letters]
        self._pretokens = regex.compile(PRETOKENS)
        self._specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self._known = Memo()

    def merge(self, pretoken: bytes) -> list[int]:
        """Ids of one pretoken."""
        first, rank_of, wholes = self.first, self.ranks.get, self.wholes
        sym = [first[b] for b in pretoken]
        n = len(sym)
        sym[-1] = self.last[pretoken[-1]]
        # an entry is rank << PLACE | position: the least rank first, and the leftmost of equal ones
        queue = []
        left = sym[0]
        for i in range(1, n):
            right = sym[i]
            if (rank := rank_of(left << PAIR | right)) is not None:
                queue.append(rank << PLACE | i - 1)
            left = right
        if not queue:
            return sym
        heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> PLACE, entry & PLACES
            j = after[i]
            if j >= n or sym[i] < 0 or rank_of(sym[i] << PAIR | sym[j]) != rank:
                continue  # stale: one of the two was merged meanwhile
            whole = sym[i] = wholes[rank]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(whole << PAIR | sym[k])) is not None:
                    heappush(queue, rank << PLACE | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(sym[h] << PAIR | whole)) is not None:
                heappush(queue, rank << PLACE | h)
        return [s for s in sym if s >= 0]

    def _pretoken(self, p: str) -> list[int]:
        if (ids := self._known.get(p)) is None:
            ids = self.merge(p.encode("utf-8", "surrogatepass"))
            self._known.keep(p, ids)
        return ids

    def split(self, word: str) -> list[str]:
        """Pretokens of a normalised run of characters without white space."""
        if max(word) < LATIN_END:  # letters are the same in every Unicode version
            if word.isalpha():
                return [word]
            if (stem := word[:-1]).isalpha() and not word[-1].isalnum():
                return [stem, word[-1]]
        return self._pretokens.findall(word)

    def word(self, word: str) -> list[int]:
        """Ids of a normalised run of characters without white space."""
        out: list[int] = []
        for p in self.split(word):
            out += self._pretoken(p)
        return out

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """The text as normalised words, each list followed by the id of the special string after it."""
        at = 0
        if "<|" in text:
            for m in self._specials.finditer(text):
                yield words_of(text[at : m.start()]), self.special[m[0]]
                at = m.end()
        yield words_of(text[at:] if at else text), None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words, special in self.pieces(text):
            for w in words:
                out += self.word(w)
            if special is not None:
                out.append(special)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def folded(text: str) -> str:
    """NFC, lower case (each character by itself, so without final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])


def words_of(text: str) -> list[str]:
    """The folded text, cut at white space."""
    text = folded(text)
    if _odd_controls.search(text):
        return [w for w in _separators.split(text) if w]
    return text.split()


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Rendered(Memo):
    """Word to (number of ids, ids as text, vocabulary strings as text)."""

    def __init__(self, vocab: Vocabulary) -> None:
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> tuple[int, str, str]:
        ids = self.vocab.word(word)
        out = len(ids), " ".join(map(str, ids)), self.vocab.decode(ids)
        self.keep(word, out)
        return out


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array<int>): the ids of every text. Null texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for b in small(batches):
            ids = [vocab.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_documents(encoded_docs: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """key, text: the vocabulary strings of the ids, one space between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vocab.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    return encoded_docs.select(F.col(key).cast("long").alias("key"), F.col("ids")).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, then decoded, then hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        cache = _Rendered(vocab)
        look = cache.__getitem__
        for b in small(batches):
            counts, ids, decoded = [], [], []
            for t in b.column(1).to_pylist():
                parts = []
                with no_collector():
                    for words, special in vocab.pieces(t or ""):
                        parts += map(look, words)
                        if special is not None:
                            parts.append((1, str(special), vocab.strings[special]))
                counts.append(sum([p[0] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


__all__ = ["Vocabulary", "decode_documents", "encode_documents", "token_digests", "vocabulary"]
