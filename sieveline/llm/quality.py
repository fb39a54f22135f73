"""Quality rules by n-gram perplexity (operator 9).

A modified Kneser-Ney model over the bytes of the texts (order 4, ASCII lower-cased, white space as one blank each) is
counted by Spark over all documents, for each language. Log probabilities of the n-grams of at least 1/HOT_GRAMS of all occurrences,
so of at most HOT_GRAMS of them, go to all tasks in two arrays sorted by language and n-gram; those of all others stay dealt by hash
and are joined to the rare n-grams that each document hands on. None share an entry. A document's perplexity is that of its bytes;
each language has a lower and an upper bound, FENCE interquartile ranges outside the quartiles of its documents' perplexities,
and documents beyond them are rejected.

Above the bytes, whole words are counted too (ASCII lower-cased; those without a letter or digit are left out, so that separators
don't make a text look usual). A word's probability leaves out the very occurrence that is scored (its count less one, discounted,
beside a uniform share), so words that stand nowhere else are unlikely. These counts grow with the corpus: they are dealt by hash
and joined to the documents' rare words; only words of at least 1/HOT of all occurrences, so at most HOT of them, are broadcast.
Word perplexities have bands of their own, and a document is kept if it lies inside both.

Nulls: a null text counts as empty (no words, base_failed), a null lang is a language of its own. Texts without bytes have
no perplexity. Rows are judged one by one, repeated rows alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import WHITE, document_word_hashes, encoded, mix, run_hashes, slices
from .tools import cut, small

ORDER = 4
#: Distinct n-grams that a task holds before it hands on its counts.
HELD_GRAMS = 1 << 20
#: Perplexity bands: so many interquartile ranges of its logarithm beyond the quartiles.
FENCE = 4.0
BIN = 0.002
#: N-grams with at least this part of all occurrences are broadcast, 16 bytes each.
HOT_GRAMS = 1 << 23
#: Words with at least this part of all occurrences are broadcast; the others are dealt to buckets of about BUCKET_WORDS occurrences.
HOT = 100_000
BUCKET_WORDS = 1 << 23
#: Texts whose rare words are asked for together.
CHUNK_BYTES, CHUNK_ROWS = 8 << 20, 60_000
MIN_WORDS = 50
SMALL_ROWS = 10_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[WHITE] = 0x20
_FOLD[0] = 0x20  # zero bytes are kept for the margins of texts
_FOLD[0x41:0x5B] += 0x20
_MARGIN = b"\0" * (ORDER - 1)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def grams(texts: list[bytes]) -> np.ndarray:
    """The n-gram that ends at each byte of the texts, packed into 32 bits, the byte itself lowest; zeros stand before a text."""
    body = np.frombuffer(_MARGIN + _MARGIN.join(texts), np.uint8)
    inner = np.ones(len(body), bool)
    at = 0
    for t in texts:
        inner[at : at + ORDER - 1] = False
        at += len(t) + ORDER - 1
    b = np.where(inner, _FOLD[body], np.uint8(0)).astype(np.uint32)
    g = b[3:] | b[2:-1] << np.uint32(8) | b[1:-2] << np.uint32(16) | b[:-3] << np.uint32(24)
    return g[inner[3:]]


def slots(lang: str | None, gram: np.ndarray) -> np.ndarray:
    """Hash of the language (31 bits) before the whole n-gram."""
    seed = (zlib.crc32((lang or "").encode()) + 1 + (lang is None)) & 0x7FFFFFFF
    return gram.astype(np.int64) | np.int64(seed << 32)


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, slot, gram, n: n-grams of all texts, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) == 1:
                return parts[0]
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = merged(parts)
                for at in range(0, len(keys), 50_000):
                    k = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(slots(lang, k)), pa.array(k.astype(np.int64)), pa.array(n[at : at + 50_000])], ["lang", "slot", "gram", "n"])
            held.clear()

        for b in small(batches):
            texts, by = encoded(b.column(1)), {}
            for i, lang in enumerate(b.column(0).to_pylist()):
                by.setdefault(lang, []).append(texts[i])
            for lang, own in by.items():
                for first, last in slices(own, 4 << 20):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(grams(own[first:last]), return_counts=True))
                    if len(parts) >= 8:
                        held[lang] = [merged(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 8 * HELD_GRAMS or len(held) > 500:
                yield from out()
        yield from out()

    each = docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, slot long, gram long, n long")
    return each.groupBy("lang", "slot", "gram").agg(F.sum("n").alias("n"))


def discounts(grams: DataFrame) -> DataFrame:
    """of, d1, d2, d3: the discounts of each language, from the counts of its counts ``c``."""
    n = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    d = [F.when(F.col(f"n{k}") > 0, F.greatest(F.lit(0.1), F.least(F.lit(k - 0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0))))).otherwise(F.lit(k * 0.5)).alias(f"d{k}") for k in (1, 2, 3)]
    made = grams.groupBy("lang").agg(*n).select(F.col("lang").alias("of"), *d)
    return F.broadcast(made) if made.count() <= SMALL_ROWS else made


def kneser_ney(counts: DataFrame) -> DataFrame:
    """lang, slot, n, logp: interpolated modified Kneser-Ney log probability of each n-gram's last byte after the others.

    ``counts`` has the n-grams of the highest order; those of lower orders are counted by their distinct left extensions.
    """

    def level(grams: DataFrame, lower: DataFrame | None) -> DataFrame:
        """grams: lang, gram, c, ...; lower: lang, gram, p of the next lower order."""
        d = discounts(grams.select("lang", "c"))
        g = grams.join(d, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = Window.partitionBy("lang", F.shiftright("gram", 8))
        g = g.withColumn("all", F.sum("c").over(context)).withColumn("gone", F.sum(off).over(context)).withColumn("own", (F.col("c") - off) / F.col("all"))
        if lower is None:
            back = F.lit(1 / 255)
        else:
            low = lower.select(F.col("lang").alias("low_lang"), F.col("gram").alias("low_gram"), F.col("p").alias("low_p"))
            g = g.join(low, F.col("lang").eqNullSafe(F.col("low_lang")) & (F.col("suffix") == F.col("low_gram")), "left")
            back = F.coalesce("low_p", F.lit(1 / 255))
        return g.withColumn("p", F.col("own") + F.col("gone") / F.col("all") * back)

    levels = [counts.select("lang", "slot", "gram", F.col("n").alias("c"), F.col("gram").bitwiseAND((1 << 24) - 1).alias("suffix"))]
    for k in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.col("suffix").alias("gram")).agg(F.count("*").alias("c")).withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)))
    below = None
    for grams in reversed(levels):
        below = level(grams, below)
    return below.select("lang", "slot", F.col("c").alias("n"), F.log("p").alias("logp"))


def gram_model(docs: DataFrame) -> DataFrame:
    """slot, n, logp (in millionths) of each n-gram of a language."""
    model = kneser_ney(cut(count_grams(docs)))
    # languages whose hashes meet share entries
    return cut(model.groupBy("slot").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("logp") * F.col("n")) / F.sum("n") * 1_000_000).cast("long").alias("logp")))


def hot_grams(model: DataFrame, total: int) -> Broadcast:
    """Sorted slots and log probabilities of the n-grams of at least 1/HOT_GRAMS of all ``total`` occurrences."""
    hot = model.where(F.col("n") * HOT_GRAMS >= total).select("slot", "logp").toArrow()
    at, logp = hot.column("slot").to_numpy(), hot.column("logp").to_numpy()
    order = np.argsort(at)
    return model.sparkSession.sparkContext.broadcast((at[order], logp[order]))


def rare_gram_sums(scores: DataFrame, model: DataFrame, total: int) -> DataFrame:
    """of, gram_sum, gram_n: sums over the rare n-grams that rows with an equal key handed on together, and their number."""
    rare = model.where(F.col("n") * HOT_GRAMS < total).select("slot", "logp")
    asked = scores.select(F.col("key").alias("of"), F.explode("rare_grams").alias("slot"))
    return asked.join(rare, "slot").groupBy("of").agg(F.sum("logp").alias("gram_sum"), F.count("*").alias("gram_n"))


def words_in(texts: list[bytes], langs: list[str | None]) -> Iterator[tuple[str | None, np.ndarray, np.ndarray]]:
    """Language, text and hash of the words that have a letter or digit; the hash is of language and word."""
    by: dict[str | None, list[int]] = {}
    for i, lang in enumerate(langs):
        if texts[i]:
            by.setdefault(lang, []).append(i)
    for lang, own in by.items():
        seed = np.uint64((zlib.crc32((lang or "").encode()) + 1 + (lang is None)) << 31)
        for first, last in slices([texts[i] for i in own]):
            group = [texts[i] for i in own[first:last]]
            body = _FOLD[np.frombuffer(b" ".join(group) + b" ", np.uint8)]
            starts, ends, hashes = run_hashes(body)
            letters = np.concatenate([[0], np.cumsum(_LETTER[body])])
            real = letters[ends] > letters[starts]
            at = np.searchsorted(np.cumsum([len(t) + 1 for t in group]), starts[real], side="right")
            yield lang, np.array(own[first:last])[at], mix(hashes[real] ^ seed)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, c: occurrences of every word, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = merged(parts)
                for at in range(0, len(keys), 50_000):
                    k = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[at : at + 50_000])], ["lang", "word", "c"])
            held.clear()

        for b in small(batches):
            for lang, _, words in words_in(encoded(b.column(1)), b.column(0).to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(np.unique(words, return_counts=True))
                if len(parts) >= 16:
                    held[lang] = [merged(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 4 * HELD_GRAMS or len(held) > 500:
                yield from out()
        yield from out()

    each = docs.select(F.col("lang").cast("string"), "text").mapInArrow(run, "lang string, word long, c long")
    return each.groupBy("lang", "word").agg(F.sum("c").alias("c"))


def word_model(counts: DataFrame) -> DataFrame:
    """word, c, logp: log probability (in millionths) of one occurrence of each word after all the other ones of its language."""
    d = discounts(counts.select("lang", "c"))
    off = lambda c: F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).when(c > 2, F.col("d3")).otherwise(F.lit(0.0))
    c = F.col("c")
    numbers = counts.join(d, F.col("lang").eqNullSafe(F.col("of"))).groupBy("of", "d1", "d2", "d3").agg(F.sum("c").alias("all"), F.count("*").alias("distinct"), *[F.count_if(k).alias(n) for n, k in (("n1", c == 1), ("n2", c == 2), ("n3", c > 2))])
    gone = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("all")
    made = cut(numbers.select("of", "d1", "d2", "d3", "all", (gone / (F.col("distinct") + 1)).alias("back")))
    made = F.broadcast(made) if made.count() <= SMALL_ROWS else made
    p = (c - 1 - off(c - 1)) / F.greatest(F.col("all") - 1, F.lit(1)) + F.col("back")
    return counts.join(made, F.col("lang").eqNullSafe(F.col("of"))).select("word", "c", F.round(F.log(p) * 1_000_000).cast("long").alias("logp"))


_ASKED = "bucket long, words binary, runs binary, members binary, keys binary"


def rare_words(docs: DataFrame, hot: Broadcast, bits: int) -> DataFrame:
    """bucket, words, runs, members, keys: for chunks of texts the sorted rare words of a bucket, how often each occurs, in which texts, and the texts' keys."""

    def asked(parts: list[tuple[np.ndarray, np.ndarray]], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not parts:
            return
        key, member, word = np.concatenate(keys), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((member, word))
        member, word = member[order], word[order]
        bucket = word >> np.uint64(64 - bits)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(word)]]) if len(word) else np.zeros(1, int)
        rows: list[tuple[int, bytes, bytes, bytes, bytes]] = []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            words, runs = np.unique(word[a:z], return_counts=True)
            texts, members = np.unique(member[a:z], return_inverse=True)
            rows.append((int(bucket[a]), words.tobytes(), runs.astype("<u4").tobytes(), members.astype("<u2").tobytes(), key[texts].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], [c.split()[0] for c in _ASKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value[0]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        keys: list[np.ndarray] = []
        size = rows = 0
        for b in small(batches):
            texts = encoded(b.column(2))
            for _, at, words in words_in(texts, b.column(1).to_pylist()):
                rare = ~np.isin(words, known)
                parts.append((at[rare] + rows, words[rare]))
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            size, rows = size + sum(map(len, texts)), rows + len(texts)
            if size >= CHUNK_BYTES or rows + b.num_rows > CHUNK_ROWS:
                yield from asked(parts, keys)
                parts, keys, size, rows = [], [], 0, 0
        yield from asked(parts, keys)

    return docs.select(_key(), F.col("lang").cast("string"), "text").mapInArrow(run, _ASKED)


def _key() -> Column:
    return F.xxhash64("doc_id", F.col("lang").cast("string"), "text").alias("key")


def word_sums(docs: DataFrame, model: DataFrame, hot: Broadcast, bits: int) -> DataFrame:
    """key, rare_sum, rare_n: sum of the log probabilities of a text's rare words (of rows with an equal key together), and their number."""

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        words, logp = right.column("word").to_numpy().view(np.uint64), right.column("logp").to_numpy()
        order = np.argsort(words)
        words, logp = words[order], logp[order].astype(np.float64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
        for w, runs, members, keys in zip(*(left.column(c).to_pylist() for c in ("words", "runs", "members", "keys")), strict=True):
            each = np.repeat(logp[np.searchsorted(words, np.frombuffer(w, np.uint64))], np.frombuffer(runs, "<u4"))
            at, key = np.frombuffer(members, "<u2"), np.frombuffer(keys, np.int64)
            found.append((key, np.bincount(at, each, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))))
        return pa.table({n: pa.array(np.concatenate(c), pa.int64()) for n, c in zip(("key", "s", "n"), zip(*found, strict=True), strict=True)})

    rare = model.select(F.shiftrightunsigned("word", 64 - bits).alias("bucket"), "word", "logp")
    parts = rare_words(docs, hot, bits).groupBy("bucket").cogroup(rare.groupBy("bucket")).applyInArrow(answered, "key long, s long, n long")
    return parts.groupBy("key").agg(F.sum("s").alias("rare_sum"), F.sum("n").alias("rare_n"))


def base_counts(text: bytes, words: np.ndarray, raw: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text; raw: its bytes, words: their hashes."""
    n = len(words)
    chars = int(np.count_nonzero(~WHITE[raw] & (raw & 0xC0 != 0x80))) if n else 0
    symbols = int(np.count_nonzero(SYMBOLS[raw]))
    seen: set[bytes] = set()
    again = 0
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                again += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
    repeated = 0
    if n > 3:
        w = mix(words[:-2]) + mix(words[1:-1] + np.uint64(1)) * np.uint64(3) + mix(words[2:] + np.uint64(2)) * np.uint64(5)
        order = np.argsort(w)
        same = np.empty(len(w) + 1, bool)
        same[0] = same[-1] = False
        same[1:-1] = w[order][1:] == w[order][:-1]
        twice = order[same[1:] | same[:-1]]
        if len(twice):
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[twice + k] = True
            repeated = int(covered.sum())
    return n, chars, symbols, again, repeated


_SCORED = "doc_id long, lang string, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, key long, hot_sum long, all_n long, hot_n long, bytes long, gram_hot long, rare_grams array<long>"


def scored(docs: DataFrame, model: Broadcast, hot: Broadcast) -> DataFrame:
    """Base counts of every whole text, the sums over its hot words and n-grams, the numbers of all and of hot words, and its rare n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, logp = model.value
        known, known_logp = hot.value
        for b in small(batches):
            texts, langs = encoded(b.column(3)), b.column(1).to_pylist()
            rows = [base_counts(t, w, np.frombuffer(t, np.uint8)) for t, w in zip(texts, document_word_hashes(texts), strict=True)]
            gram_sums = np.zeros(len(texts), np.int64)
            rare: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
            by: dict[str | None, list[int]] = {}
            for i, lang in enumerate(langs):
                if texts[i]:
                    by.setdefault(lang, []).append(i)
            for lang, own in by.items():
                for first, last in slices([texts[i] for i in own]):
                    group = own[first:last]
                    which = slots(lang, grams([texts[i] for i in group]))
                    place = np.minimum(np.searchsorted(at, which), max(len(at) - 1, 0))
                    here = at[place] == which if len(at) else np.zeros(len(which), bool)
                    values = np.where(here, logp[place], 0) if len(at) else np.zeros(len(which), np.int64)
                    ends = np.cumsum([len(texts[i]) for i in group])
                    gram_sums[group] = np.add.reduceat(values, np.concatenate([[0], ends[:-1]]))
                    gone = np.flatnonzero(~here)
                    for i, part in zip(group, np.split(which[gone], np.searchsorted(gone, ends[:-1])), strict=True):
                        rare[i] = part
            totals = np.zeros((3, len(texts)), np.int64)
            for _, which, words in words_in(texts, langs):
                place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                is_hot = known[place] == words if len(known) else np.zeros(len(words), bool)
                totals[0] += np.bincount(which[is_hot], known_logp[place[is_hot]], len(texts)).astype(np.int64)
                totals[1] += np.bincount(which, minlength=len(texts))
                totals[2] += np.bincount(which[is_hot], minlength=len(texts))
            columns = [b.column(0), pa.array(langs, pa.string()), b.column(2), *(pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [()] * 5)), b.column(4), *(pa.array(t, pa.int64()) for t in totals)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rare])]), pa.int32()), pa.array(np.concatenate(rare) if rare else np.empty(0, np.int64), pa.int64()))
            columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array(gram_sums), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.xxhash64("text").alias("row"), "text", _key()).mapInArrow(run, _SCORED)


def bands(scores: DataFrame, column: str = "log_perplexity") -> DataFrame:
    """lang, lower, upper: bounds of ``column``, from a histogram of all documents that have one and pass the base rules."""
    histogram = scores.where(F.col(column).isNotNull() & ~F.col("base_failed")).groupBy("lang", F.floor(F.col(column) / BIN).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang").orderBy("bin")
    share = histogram.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    quartile = [F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN)).alias(name) for q, name in ((0.25, "q1"), (0.75, "q3"))]
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(BIN)) * FENCE
    return share.groupBy("lang").agg(*quartile).select("lang", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def perplexities(docs: DataFrame) -> DataFrame:
    """What ``scored`` gives, base_failed, and log_words: the log perplexity of the words."""
    counts = cut(count_words(docs))
    model = word_model(counts)
    total = counts.agg(F.sum("c")).first()[0] or 0
    bits = max(3, (total // BUCKET_WORDS).bit_length())
    is_hot = F.col("c") * HOT >= total
    top = model.where(is_hot).select("word", "logp").toArrow()
    words, logp = top.column("word").to_numpy().view(np.uint64), top.column("logp").to_numpy().astype(np.float64)
    order = np.argsort(words)
    hot = docs.sparkSession.sparkContext.broadcast((words[order], logp[order]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    byte_model = gram_model(docs)
    n_bytes = byte_model.agg(F.sum("n")).first()[0] or 0
    scores = cut(scored(docs, hot_grams(byte_model, n_bytes), hot).withColumn("base_failed", failed))
    rare = rare_gram_sums(scores, byte_model, n_bytes)
    scores = scores.join(rare, F.col("key") == F.col("of"), "left").drop("of")
    own = F.coalesce(F.col("gram_sum") * (F.size("rare_grams") / F.col("gram_n")), F.lit(0.0))
    each = F.when(F.col("bytes") > 0, F.round(-(F.col("gram_hot") + own) / 1_000_000 / F.col("bytes"), 9))
    scores = scores.withColumn("log_perplexity", each).drop("bytes", "gram_hot", "rare_grams", "gram_sum", "gram_n")
    sums = word_sums(docs, model.where(~is_hot), hot, bits).withColumnRenamed("key", "of")
    own = F.coalesce(F.col("rare_sum") * ((F.col("all_n") - F.col("hot_n")) / F.col("rare_n")), F.lit(0.0))
    each = F.when(F.col("all_n") > 0, F.round(-(F.col("hot_sum") + own) / 1_000_000 / F.col("all_n"), 9))
    return cut(scores.join(sums, F.col("key") == F.col("of"), "left").withColumn("log_words", each).drop("of", "key", "rare_sum", "rare_n", "hot_sum"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, word_perplexity, row (hash of the text) of every document."""
    joined = perplexities(docs)
    inside = F.lit(True)
    for column, name in (("log_perplexity", "bytes"), ("log_words", "words")):
        limits = bands(joined, column).toDF(f"of_{name}", f"lower_{name}", f"upper_{name}")
        limits = F.broadcast(limits) if limits.count() <= SMALL_ROWS else limits
        joined = joined.join(limits, F.col("lang").eqNullSafe(F.col(f"of_{name}")), "left")
        inside = inside & F.coalesce(F.col(column).between(F.col(f"lower_{name}"), F.col(f"upper_{name}")), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.exp("log_perplexity").alias("perplexity"), F.exp("log_words").alias("word_perplexity"), "row")
