"""Toxicity by a convolutional text classifier (operator 2).

A word's embedding is the sum of hashed embeddings of the word and of its first bytes (so inflected forms share what they
learn); filters of several widths slide over the embeddings and each filter's maximum over the text feeds a logistic
output. Training is plain numpy on the driver, on a bounded sample of labelled documents (TRAIN_DOCUMENTS of each class and
TRAIN_CHARS characters at most, the first ones by a hash of doc_id); one embedding dimension starts from the smoothed class
log odds of its bucket. A fifth of the sample sets the output's scale and, for each language, the threshold of ``flagged``.
Every whole text is scored in Spark, in Arrow batches.

doc_id, lang, source and labels are no inputs of a score. Null or empty texts get the score of a text without words; rows
with a null doc_id are scored and are not held out. Repeated rows score alike, other columns are ignored, an empty
table gives no rows. Labels that contradict each other for one doc_id are left out. Without labelled rows of both classes there is
nothing to learn: every score is 0.4 times the share of toxic rows among the labelled ones, predicted 0. A very long text is read
whole, in parts of LONG_WORDS words that overlap, so memory is that of its word hashes and one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import WHITE, _BYTE_VALUES, _powers, encoded, mix, run_hashes, slices, text_parts
from .tools import small

TRAIN_DOCUMENTS = 2500
TRAIN_CHARS = 60_000_000
BUCKETS = 1 << 17
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 6)
EPOCHS = 4
FEATURES = 1 + len(PREFIXES)
SLICE = 1 << 18
#: Words of a long text that are pooled together.
LONG_WORDS = 1 << 16
COLUMNS = FILTERS * sum(WIDTHS)

#: Words of this operator are runs of bytes that are neither ASCII punctuation nor white space.
_BREAKS = WHITE.copy()
_BREAKS[[*range(0x20), *range(0x20, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def word_buckets(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words, and a row of FEATURES buckets for each; ``text`` is lower-cased bytes."""
    starts, ends, hashes = run_hashes(text, _BREAKS)
    out = np.empty((len(starts), FEATURES), np.int32)
    if len(starts):
        shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
        out[:, 0] = (hashes >> shift).astype(np.int32)
        up, down = _powers.upto(len(text))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[text] * up)])
        for k, n in enumerate(PREFIXES, 1):
            part = (sums[np.minimum(starts + n, ends)] - sums[starts]) * down[starts]
            out[:, k] = (mix(part + np.uint64(k)) >> shift).astype(np.int32)
    return starts, out


@dataclass
class Network:
    """Embeddings (BUCKETS x DIM, and a row of zeros), a filter bank (DIM x COLUMNS), and the output layer."""

    embed: np.ndarray
    bank: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def pooled(self, table: np.ndarray, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each document, which ends in rows of zeros; no window reaches into the next document."""
        rows = table[buckets[:, 0]]
        for k in range(1, FEATURES):
            rows += table[buckets[:, k]]
        out, at = [], 0
        for width in WIDTHS:
            z = rows[: len(rows) - width + 1, at : at + FILTERS].copy()
            for o in range(1, width):
                z[:] += rows[o : len(rows) - width + 1 + o, at + o * FILTERS : at + (o + 1) * FILTERS]
            ends = np.append(bounds[1:], len(rows)) - width + 1
            edges = np.stack([bounds, ends], axis=1).ravel()
            out.append(np.maximum.reduceat(z, edges[:-1] if edges[-1] == len(z) else edges, axis=0)[::2])
            at += width * FILTERS
        return np.maximum(np.concatenate(out, axis=1) + self.bias, 0)

    def pooled_long(self, table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """``pooled`` of one long document, part by part: parts overlap by the widest filter."""
        best = None
        for at in range(0, len(buckets), LONG_WORDS):
            part = buckets[at : at + LONG_WORDS + max(WIDTHS) - 1]
            if at and len(part) < max(WIDTHS):
                break  # the part before has seen these
            made = self.pooled(table, part, np.zeros(1, np.int64))
            best = made if best is None else np.maximum(best, made)
        return best

    def table(self) -> np.ndarray:
        return self.embed @ self.bank

    def logits(self, table: np.ndarray, texts: list[bytes]) -> np.ndarray:
        total = []
        for first, last in slices(texts, SLICE):
            group = [t.lower() for t in texts[first:last]]
            if len(group) == 1 and len(group[0]) > SLICE:
                parts = [word_buckets(p)[1] for p in text_parts(group[0], _BREAKS)]
                buckets = np.concatenate([*parts, np.full((3, FEATURES), BUCKETS, np.int32)]).astype(np.int32)
                total.append(self.pooled_long(table, buckets) @ self.out + self.offset)
                continue
            joined = b"\n".join(group) + b"\n"
            starts, found = word_buckets(np.frombuffer(joined, np.uint8))
            bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in group]))
            n = len(group)
            buckets = np.full((len(found) + 3 * n, FEATURES), BUCKETS, np.int32)
            shift = np.repeat(np.arange(n), np.diff(bounds)) * 3
            buckets[np.arange(len(found)) + shift] = found
            total.append(self.pooled(table, buckets, bounds[:-1] + 3 * np.arange(n)) @ self.out + self.offset)
        return np.concatenate(total) if total else np.empty(0)

    def scores(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))


def train(documents: list[tuple[np.ndarray, int, str | None]], seed: int = 7) -> Network:
    """``documents``: buckets of the words, label, language. The last fifth calibrates."""
    rng = np.random.Generator(np.random.PCG64(seed))
    held = [d for i, d in enumerate(documents) if i % 5 == 4]
    used = [d for i, d in enumerate(documents) if i % 5 != 4]
    positives = sum(d[1] for d in used)
    seen = np.zeros((2, BUCKETS))
    for buckets, label, _ in used:
        seen[label, np.unique(buckets)] += 1
    n = seen.sum(axis=0)
    odds = np.log((seen[1] + 0.5) / (positives + 1)) - np.log((seen[0] + 0.5) / (len(used) - positives + 1))
    embed = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
    embed[:-1, 0] = np.where(n > 0, np.maximum(odds, -1) * n / (n + 5), 0) / FEATURES
    embed[-1] = 0
    bank = rng.normal(0, 0.05, (DIM, COLUMNS)).astype(np.float32)
    bank[0] += 0.5
    net = Network(embed, bank, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 2.0 / (len(WIDTHS) * FILTERS), np.float32), -2.0)
    if not positives or positives == len(used):
        net.out[:] = 0
        share = 0.4 * positives / max(len(used), 1)
        net.offset = float(np.log(share / (1 - share))) if share else -40.0
        return net
    weight = len(used) / 2 / np.array([len(used) - positives, positives])
    squares = np.full(BUCKETS + 1, 1e-3, np.float32)
    for epoch in range(EPOCHS):
        rate = 0.05 / (1 + epoch)
        for i in rng.permutation(len(used)):
            buckets, label, _ = used[i]
            padded = np.concatenate([buckets, np.full((3, FEATURES), BUCKETS, np.int32)])
            x = net.embed[padded].sum(axis=1)
            x[:-3] *= rng.random((len(buckets), 1)) > 0.1  # words are dropped at random
            z, pos, at = [], [], 0
            for width in WIDTHS:
                m = len(x) - width + 1
                c = sum(x[o : m + o] @ net.bank[:, at + o * FILTERS : at + (o + 1) * FILTERS] for o in range(width))
                p = c.argmax(axis=0)
                z.append(c[p, np.arange(FILTERS)])
                pos.append(p)
                at += width * FILTERS
            h = np.concatenate(z) + net.bias
            live = h > 0
            h = np.where(live, h, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.offset, -40, 40)))
            g = float((p - label) * weight[label])
            dh = np.where(live, g * net.out, 0).astype(np.float32)
            net.out -= rate * (g * h + 1e-4 * net.out).astype(np.float32)
            net.offset -= rate * g
            net.bias -= rate * dh
            at = 0
            for w, width in enumerate(WIDTHS):
                d = dh[w * FILTERS : (w + 1) * FILTERS]
                for o in range(width):
                    cols = slice(at + o * FILTERS, at + (o + 1) * FILTERS)
                    where = pos[w] + o
                    dx = d[:, None] * net.bank[:, cols].T
                    net.bank[:, cols] -= rate * 0.2 * (x[where].T * d)
                    rows = padded[where].ravel()
                    grad = np.repeat(dx, FEATURES, axis=0)
                    np.add.at(squares, rows, (grad**2).mean(axis=1))
                    np.add.at(net.embed, rows, -rate * grad / np.sqrt(squares[rows])[:, None] * 0.3)
                at += width * FILTERS
            net.embed[-1] = 0
    _calibrate(net, held)
    return net


def _calibrate(net: Network, held: list[tuple[np.ndarray, int, str | None]]) -> None:
    """Scale of the output (a regularised logistic fit), and thresholds by language for the best F1."""
    table = net.table()
    logits = []
    for buckets, _, _ in held:
        padded = np.concatenate([buckets, np.full((3, FEATURES), BUCKETS, np.int32)])
        logits.append(float((net.pooled(table, padded, np.array([0])) @ net.out)[0] + net.offset))
    x, y = np.array(logits), np.array([d[1] for d in held], float)
    if not y.sum() or y.sum() == len(y):
        return
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    a, b = 1.0, 0.0
    for _ in range(2000):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        e = weight * (p - target)
        a, b = max(0.05, a - 0.2 * float((e * x).sum() + 1e-3 * (a - 1))), b - 0.5 * float(e.sum())
    net.scale = (a, b)
    s = net.scores(x)
    langs = np.array([str(d[2]) for d in held])
    for lang in {d[2] for d in held}:
        own = langs == str(lang)
        if y[own].sum() >= 3:
            cuts = np.unique(np.concatenate([s[own & (y == 1)], [0.5]]))
            f1 = [2 * (y[own] * (s[own] >= c)).sum() / (y[own].sum() + (s[own] >= c).sum()) for c in cuts]
            best = np.flatnonzero(np.array(f1) == max(f1))
            net.thresholds[lang] = 0.5 if max(f1) == f1[int(np.flatnonzero(cuts == 0.5)[0])] else float(cuts[best[0]])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[np.ndarray, int, str | None]]:
    """The training sample: buckets of the words, label and language of a bounded number of labelled documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    order = F.xxhash64("doc_id", F.lit(11))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    chosen = [r for t in (1, 0) for r in labels.where(F.col("toxic") == t).orderBy(order).limit(TRAIN_DOCUMENTS).collect()]
    if not chosen:
        return []
    # at most 2 * TRAIN_DOCUMENTS rows are broadcast
    few = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int"))
    sizes = {(r["toxic"], r["doc_id"]): r["n"] for r in docs.join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.length("text")).alias("n")).collect()}
    kept, total = [], 0
    turn = {t: [r["doc_id"] for r in chosen if r["toxic"] == t] for t in (0, 1)}
    for i in range(TRAIN_DOCUMENTS):
        for t in (1, 0):
            if i < len(turn[t]) and (t, turn[t][i]) in sizes and total + (sizes[t, turn[t][i]] or 0) <= TRAIN_CHARS:
                kept.append((turn[t][i], t))
                total += sizes[t, turn[t][i]] or 0
    few = F.broadcast(spark.createDataFrame(kept, "doc_id long, toxic int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [word_buckets(np.frombuffer(t.lower(), np.uint8))[1].tobytes() for t in encoded(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], ["doc_id", "toxic", "lang", "buckets"])

    rows = docs.join(few, "doc_id").select("doc_id", "toxic", "lang", "text").mapInArrow(run, "doc_id long, toxic int, lang string, buckets binary").collect()
    rows = {r["doc_id"]: r for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"] or "", bytes(r["buckets"])), reverse=True)}
    return [(np.frombuffer(bytes(rows[d]["buckets"]), np.int32).reshape(-1, FEATURES), t, rows[d]["lang"]) for d, t in kept if d in rows]


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted, flagged (score at least its language's threshold) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        table = net.table()
        for b in small(batches):
            s = net.scores(net.logits(table, encoded(b.column(2))))
            limit = np.array([net.thresholds.get(k, 0.5) for k in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(s >= limit)], ["doc_id", "score", "predicted", "flagged"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), "text").mapInArrow(run, "doc_id long, score double, predicted int, flagged boolean")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "flagged")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that are not held out, and score every document."""
    documents = sample(docs, labels)
    return score(docs, train(documents))
