"""Topics by non-negative matrix factorisation (ML5): sparse TF-IDF, then multiplicative updates over blocks of documents.

The matrix of documents and terms is cut into blocks of ``BLOCK_ROWS`` documents. Its first factor (documents x topics) grows with the
input and stays in the same blocks; its second one (topics x terms) is bounded by ``size`` terms and goes to all tasks. A round is one pass:
each block updates its own weights against the terms' factor and gives its part of two products (topics x terms, topics x topics) and
of the squared error; a task adds up its blocks, Spark adds up the tasks term by term, and the terms' factor is updated. Blocks are
neither shuffled nor written in a round: their weights are found again from the terms' factors of the rounds since they were last
kept, every ``KEPT`` rounds. No update can raise the error. Rounds end when the error falls by less than ``tolerance`` of the first one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .lineage import cut

BLOCK_ROWS = 1024
SLICE = 1 << 15
LEAST = 1e-12
KEPT = 10
#: Tokens that are counted together, and words that are sent to all tasks to tell which pairs are worth counting.
TOKENS = 1 << 19
BROADCAST_WORDS = 1_000_000


def _grams(rows: DataFrame, pairs: bool) -> DataFrame:
    """key, term, n: words, and pairs of neighbouring words if asked for, with their counts. Rows of equal keys count together."""
    two = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    return rows.select("key", F.explode(F.concat("w", two) if pairs else F.col("w")).alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"))


def _parted(docs: DataFrame, key: str, tokens: Column) -> tuple[DataFrame, DataFrame | None]:
    """key, w of the rows whose key no other row has, and of the rest (None if there is none). Only keys are grouped for it."""
    rows = docs.select(F.col(key).alias("key"), tokens.alias("w"))
    repeated = cut(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("again")))
    if repeated.isEmpty():
        return rows, None
    same = rows["key"].eqNullSafe(repeated["again"])
    return rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray, np.ndarray]]:
    """Rows of at most ``TOKENS`` tokens, or one row, with their distinct words, and the word's and the row's number of each token."""
    for b in batches:
        lists = b.column(b.schema.names.index("w"))
        upto = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOKENS, "right")))
            own = np.diff(upto[at:end], prepend=upto[at - 1] if at else 0)
            coded = lists.slice(at, end - at).flatten().dictionary_encode()
            yield b.slice(at, end - at), coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(end - at), own)
            at = end


def _totals(rows: DataFrame, words: Broadcast | None) -> DataFrame:
    """term, df, all of words; with ``words`` of pairs of neighbouring words that are both among these. Sums over slices of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, known, code, row in _slices(batches):
            if words is None:
                term, which = known, code
            else:
                live = np.ones(len(known), bool) if words.value is None else pc.is_in(known, value_set=words.value).to_numpy(zero_copy_only=False)
                at = np.flatnonzero((row[1:] == row[:-1]) & live[code[1:]] & live[code[:-1]])
                pair, which = np.unique(code[at] * len(known) + code[at + 1], return_inverse=True)
                term, row = pc.binary_join_element_wise(known.take(pa.array(pair // max(len(known), 1))), known.take(pa.array(pair % max(len(known), 1))), " "), row[at]
            n = len(term)
            df = np.bincount(np.unique(row * n + which) % max(n, 1), minlength=n)
            yield pa.RecordBatch.from_arrays([term.cast(pa.string()), pa.array(df, pa.int64()), pa.array(np.bincount(which, minlength=n), pa.int64())], ["term", "df", "all"])

    return rows.select("w").mapInArrow(run, "term string, df long, all long")


def fit_vocabulary(docs: DataFrame, key: str, tokens: Column, min_df: int = 2, max_df: float = 0.22, size: int = 9000, pairs: bool = True) -> DataFrame:
    """term, place, df, idf: terms in at least ``min_df`` documents and at most the share ``max_df`` of them, the ``size`` most
    frequent ones (ties by the alphabet), with ln((1 + n) / (1 + df)) + 1. Tokens hold no blanks.

    A pair is at most as frequent as its words and in no more documents, so pairs are counted only where both words are in
    ``min_df`` documents and as frequent as the last of the ``size`` words that could be taken: no other pair can be among the terms.
    """
    total = docs.count()
    rows, again = _parted(docs, key, tokens)
    summed = lambda t: t.groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))
    counted = _totals(rows, None)
    # rows that share a key are few; all their terms are counted together
    rest = None if again is None else cut(_grams(again, pairs).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("all")))
    blank = F.contains("term", F.lit(" "))
    words = summed(counted if rest is None else counted.union(rest.where(~blank))).where(F.col("df") >= min_df)
    if pairs:
        words = cut(words)
        last = words.where(F.col("df") <= max_df * total).orderBy(F.desc("all")).select("all").limit(size).agg(F.count("*"), F.min("all")).first()
        often = words.where(F.col("all") >= (last[1] if last[0] == size else 0)).select("term")
        # size and what is as frequent as the last one or in more documents than max_df; all words where these are too many to send
        some = often.limit(BROADCAST_WORDS + 1).toArrow().column(0).combine_chunks()
        shared = docs.sparkSession.sparkContext.broadcast(some if len(some) <= BROADCAST_WORDS else None)
        two = _totals(rows, shared)
        words = words.union(summed(two if rest is None else two.union(rest.where(blank))).where(F.col("df") >= min_df))
    kept = words.where(F.col("df") <= max_df * total).orderBy(F.desc("all"), "term").limit(size)
    idf = F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1
    return cut(kept.select("term", (F.row_number().over(Window.orderBy("term")) - 1).alias("place"), "df", idf.alias("idf")))  # ``size`` rows at most


class Lexicon(NamedTuple):
    """A vocabulary as arrays, for the tasks."""

    words: pa.Array  # the words of all terms
    place: np.ndarray  # each word's place as a term, or -1
    pairs: np.ndarray  # rows of (number of the first word * number of words + number of the second, place), ascending
    idf: np.ndarray


def lexicon(vocabulary: DataFrame, pairs: bool = True) -> Lexicon:
    """As many terms as the vocabulary's size, by way of the driver."""
    told = vocabulary.select("term", "place", "idf").orderBy("place").toArrow()
    single = [t.split(" ") for t in told.column("term").to_pylist()]
    words = sorted({w for own in single for w in own})
    number = {w: i for i, w in enumerate(words)}
    place = np.full(len(words), -1, np.int64)
    for at, own in enumerate(single):
        if len(own) == 1:
            place[number[own[0]]] = at
    two = sorted((number[own[0]] * len(words) + number[own[1]], at) for at, own in enumerate(single) if len(own) == 2) if pairs else []
    return Lexicon(pa.array(words, pa.string()), place, np.array(two, np.int64).reshape(-1, 2), told.column("idf").to_numpy())


def valued(batches: Iterable[pa.RecordBatch], known: Lexicon, sublinear: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with the row, place and value of each known term in them, by row and place; a row's values have length 1."""
    words, place, two, idf = known
    for b, seen, code, row in _slices(batches):
        word = pc.index_in(seen, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code] if len(words) else np.full(len(code), -1)
        own = np.flatnonzero(word >= 0)
        own = own[place[word[own]] >= 0]
        found, where = [place[word[own]]], [row[own]]
        if len(two):
            at = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
            pair = word[at] * len(words) + word[at + 1]
            near = np.minimum(np.searchsorted(two[:, 0], pair), len(two) - 1)
            hit = two[near, 0] == pair
            found, where = [*found, two[near[hit], 1]], [*where, row[at[hit]]]
        each, n = np.unique(np.concatenate(where) * len(idf) + np.concatenate(found), return_counts=True)
        row, term = each // max(len(idf), 1), each % max(len(idf), 1)
        value = (1 + np.log(n) if sublinear else n) * idf[term]
        if len(each):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            value /= np.repeat(np.sqrt(np.add.reduceat(value**2, first)), np.diff(np.append(first, len(row))))
        yield b, row, term, value


def weighted_terms(docs: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, pairs: bool = True, sublinear: bool = True) -> DataFrame:
    """(key, terms, values) of every document with a known term: 1 + ln(count), or the count, times idf; a document's values have length 1."""
    rows, again = _parted(docs, key, tokens)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(vocabulary, pairs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, term, value in valued(batches, shared.value, sublinear):
            if not len(row):
                continue
            first = np.flatnonzero(np.diff(row, prepend=-1))
            bounds = pa.array(np.append(first, len(row)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(term, pa.int32()), pa.array(value, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("key")).take(pa.array(row[first])), *lists], ["key", "terms", "values"])

    schema = StructType([rows.schema["key"], StructField("terms", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])
    made = rows.mapInArrow(run, schema)
    if again is None:
        return made
    often = 1 + F.log("n") if sublinear else F.col("n")
    more = _grams(again, pairs).join(F.broadcast(vocabulary), "term").select("key", F.struct("place", (often * F.col("idf")).alias("value")).alias("x"))
    more = more.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x"))
    length = F.sqrt(F.aggregate("x.value", F.lit(0.0), lambda s, v: s + v * v))
    return made.union(more.select("key", F.col("x.place").alias("terms"), F.transform("x.value", lambda v: v / length).alias("values")))


class Factors(NamedTuple):
    weights: DataFrame  # key, weights (array of doubles, one for each topic)
    terms: np.ndarray  # topics x terms
    losses: list[float]  # squared error of each round


def _start(ids: np.ndarray, k: int, scale: float) -> np.ndarray:
    """Numbers in (0, scale) fixed by 64-bit ids and topics."""
    h = ids.astype(np.uint64)[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return scale * (((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _met(block: dict, h: np.ndarray) -> np.ndarray:
    """The block's documents against the terms' factor: documents x topics."""
    bounds, ht = block["bounds"], h.T
    met = np.empty((len(bounds) - 1, len(h)))
    for a, b in zip(block["cuts"][:-1], block["cuts"][1:], strict=True):
        part = slice(bounds[a], bounds[b])
        met[a:b] = np.add.reduceat(block["values"][part, None] * ht[block["terms"][part]], bounds[a:b] - bounds[a])
    return met


def _products(block: dict, old: np.ndarray, h: np.ndarray, sums: dict) -> None:
    """Adds a block's products with its new weights, and its error, to ``sums``."""
    met = _met(block, h)
    new = old * met / (old @ (h @ h.T) + LEAST)
    bounds, size = block["bounds"], h.shape[1]
    for a, b in zip(block["cuts"][:-1], block["cuts"][1:], strict=True):
        part = slice(bounds[a], bounds[b])
        told = block["values"][part, None] * np.repeat(new[a:b], np.diff(bounds[a : b + 1]), axis=0)
        for t in range(len(h)):
            sums["terms"][:, t] += np.bincount(block["terms"][part], told[:, t], size)
    square = new.T @ new
    sums["topics"] += square
    sums["error"] += (block["values"] ** 2).sum() - 2 * (new * met).sum() + (square * (h @ h.T)).sum()


def _blocks(batches: Iterable[pa.RecordBatch], past: list[np.ndarray], k: int, scale: float) -> Iterator[tuple[pa.RecordBatch, dict, np.ndarray]]:
    """Blocks one by one with their weights after the updates against ``past`` since weights were last kept."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            ids, sizes, terms, values = (one.column(one.schema.names.index(c)).flatten().to_numpy() for c in ("ids", "sizes", "terms", "values"))
            kept = one.column(one.schema.names.index("weights"))[0].as_py()
            bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            cuts = np.unique(np.concatenate([np.searchsorted(bounds, np.arange(0, bounds[-1], SLICE)), [len(ids)]]))
            block = {"terms": terms, "values": values, "bounds": bounds, "cuts": cuts}
            w = _start(ids.view(np.uint64), k, scale) if kept is None else np.frombuffer(kept).reshape(len(ids), k)
            for h in past:
                w = w * _met(block, h) / (w @ (h @ h.T) + LEAST)
            yield one, block, w


def factorise(rows: DataFrame, k: int, size: int, rounds: int = 60, tolerance: float = 1e-4) -> Factors:
    """Factors of (key, terms, values); every row has at least one term, keys are any values and may repeat."""
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    keyed = cut(rows.withColumn("id", F.xxhash64("key", "terms")))
    n, mean = keyed.agg(F.count("*"), F.sum(F.aggregate("values", F.lit(0.0), lambda s, v: s + v))).first()
    scale = float(np.sqrt((mean or 0.0) / max(n * size, 1) / k))
    many = max(1, -(-n // BLOCK_ROWS))
    parts = min(many, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = keyed.withColumn("block", F.pmod("id", F.lit(many))).repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "key", "terms", "values"))).alias("x"))
    flat = listed.select(F.col("x.id").alias("ids"), F.transform("x.terms", lambda t: F.size(t)).alias("sizes"), F.flatten("x.terms").alias("terms"), F.flatten("x.values").alias("values"), F.col("x.key").alias("keys"))
    blocks = cut(flat.withColumn("weights", F.lit(None).cast("binary")))
    schema = pa.schema([("place", pa.int64()), ("part", pa.list_(pa.float64()))])
    h = _start(np.arange(size), k, scale).T.copy()
    past, losses = [], []
    for _ in range(rounds):
        if len(past) == KEPT:
            blocks, past = cut(_kept(blocks, sc.broadcast(past), k, scale)), []
        shared = sc.broadcast([*past, h])

        def one(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            *past, h = shared.value
            sums = {"terms": np.zeros((size, k)), "topics": np.zeros((k, k)), "error": 0.0}
            for _, block, w in _blocks(batches, past, k, scale):
                _products(block, w, h, sums)
            told = np.flatnonzero(sums["terms"].any(1))
            made = np.concatenate([sums["terms"][told], sums["topics"], np.full((1, k), sums["error"])])
            places = np.concatenate([told, size + np.arange(k + 1)])
            for a in range(0, len(made), 2048):
                yield pa.RecordBatch.from_pylist([{"place": int(p), "part": m.tolist()} for p, m in zip(places[a : a + 2048], made[a : a + 2048], strict=True)], schema)

        passed = blocks.select("ids", "sizes", "terms", "values", "weights").mapInArrow(one, "place long, part array<double>")
        summed = passed.groupBy("place").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(k)]).alias("part")).collect()  # size + topics + 1 rows
        total = np.zeros((size + k + 1, k))
        for r in summed:
            total[r["place"]] = r["part"]
        past.append(h)
        losses.append(float(total[-1, 0]))
        if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * losses[0]:
            break
        h = h * total[:size].T / (total[size : size + k] @ h + LEAST)
    shared = sc.broadcast(past)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, w in _blocks(batches, shared.value, k, scale):
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("keys")).flatten(), pa.array(list(w), pa.list_(pa.float64()))], ["key", "weights"])

    made = blocks.mapInArrow(told, StructType([rows.schema["key"], StructField("weights", ArrayType(DoubleType()))]))
    return Factors(made, past[-1], losses)


def _kept(blocks: DataFrame, shared: Broadcast, k: int, scale: float) -> DataFrame:
    """The blocks with their weights of now."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, w in _blocks(batches, shared.value, k, scale):
            yield b.set_column(b.schema.names.index("weights"), "weights", pa.array([w.tobytes()], pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


def topic_shares(factors: Factors) -> DataFrame:
    """key, shares: weights that sum to 1 (all 0 where a document has none)."""
    total = F.aggregate("weights", F.lit(0.0), lambda s, v: s + v)
    return factors.weights.select("key", F.transform("weights", lambda v: F.when(total > 0, v / total).otherwise(0.0)).alias("shares"))


def top_topics(shares: DataFrame, k: int = 3, least: float = 0.08) -> DataFrame:
    """key, dominant_topic_id (the first of the greatest), dominant_topic_weight, top_topics: up to k topics (topic_id, weight) of at
    least ``least``, the greatest first, ties by the number of the topic."""
    ranked = F.array_sort(F.transform("shares", lambda v, i: F.struct((-v).alias("w"), i.alias("topic_id"))))
    top = F.transform(F.filter(F.slice(ranked, 1, k), lambda x: -x["w"] >= least), lambda x: F.struct(x["topic_id"].alias("topic_id"), F.round(-x["w"], 4).alias("weight")))
    one = shares.select("key", ranked.alias("r"), top.alias("top_topics"))
    return one.select("key", F.col("r")[0]["topic_id"].alias("dominant_topic_id"), F.round(-F.col("r")[0]["w"], 4).alias("dominant_topic_weight"), "top_topics")


def topic_terms(factors: Factors, vocabulary: DataFrame, k: int = 12) -> DataFrame:
    """topic_id, place_in_topic (from 1), term, weight: the k terms of most weight in each topic."""
    spark = vocabulary.sparkSession
    rows = [(t, i + 1, int(p), float(row[p])) for t, row in enumerate(factors.terms) for i, p in enumerate(np.lexsort((np.arange(len(row)), -row))[:k])]
    best = spark.createDataFrame(rows, "topic_id int, place_in_topic int, place int, weight double")
    return best.join(F.broadcast(vocabulary), "place").select("topic_id", "place_in_topic", "term", F.round("weight", 6).alias("weight"))
