"""Sentiment by distant supervision with cross-fitting (ML1-ML4).

Posts with exactly one of two marker words are the labelled ones. Their words and word pairs (without the markers) are weighted by
sublinear tf-idf; balanced logistic regressions are trained, one on all labelled posts and one for each fold on those outside it.
A post that is labelled is scored by the model that left its fold out, any other one by the model of all, so no post is scored by a
model that has seen it. A model is a table of term weights, at most ``SIZE`` for each model, which goes to all tasks for scoring.

All models are fitted together (quasi-Newton steps with limited memory): one pass over the labelled posts, kept by Spark as blocks of
arrays, gives losses and slopes of every model that isn't done yet. What comes back in a pass is bounded by ``SIZE``, not by the posts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import rules, text
from . import factors
from .lineage import cut

MIN_CLASS = 25
FOLDS = 5
SIZE = 25_000
SEED = 42
#: A model is done when its slope is at most this long: as the penalty is half the squared length of the weights and a post's values have
#: length 1, its weights and every post's sum are then as near to the optimum's, the constant apart.
TOLERANCE = 1e-4
PASSES = 400
#: Steps that the next one is chosen by.
MEMORY = 30
#: Terms of posts that a task goes through at once, at least (if there are as many tasks) and at most in a pass.
SLICE = 1 << 16
TASK = 1 << 22


class Model(NamedTuple):
    vocabulary: DataFrame
    weights: DataFrame  # model (-1: of all labelled posts, else of those outside that fold), place (-1: constant), weight


def marked(posts: DataFrame, key: str, column: str, positive: str = "bullish", negative: str = "bearish") -> DataFrame:
    """key, label ("positive", "negative" or null), tokens of two letters or more without the marker words, fold. Found once, and kept."""
    words = F.filter(F.regexp_extract_all(text.training_text(column), F.lit("[a-z]{2,}"), F.lit(0)), lambda w: ~w.isin(positive, negative))
    told = cut(posts.select(F.col(key).alias("key"), rules.explicit_label(column, positive, negative).alias("label"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("told"), F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(FOLDS)).cast("int").alias("fold")))
    tokens = F.when(F.col("told") == "", F.array().cast("array<string>")).otherwise(F.split("told", " "))
    return told.select("key", "label", tokens.alias("tokens"), "fold")


def _blocks(known: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Labelled posts in blocks: n (terms), and as the bytes of arrays whether a post is positive, its fold, its number of terms; terms, values."""
    shared = known.sparkSession.sparkContext.broadcast(factors.lexicon(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, term, value in factors.valued(batches, shared.value):
            own = [b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("y", "fold")]
            arrays = [own[0].astype(np.int8), own[1].astype(np.int8), np.bincount(row, minlength=b.num_rows).astype(np.int32), term.astype(np.int32), value]
            yield pa.RecordBatch.from_arrays([pa.array([len(row)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], ["n", "y", "fold", "sizes", "terms", "values"])

    rows = known.select((F.col("label") == "positive").cast("int").alias("y"), "fold", F.col("tokens").alias("w"))
    return rows.mapInArrow(run, "n long, y binary, fold binary, sizes binary, terms binary, values binary")


class _Pass(NamedTuple):
    outs: list[int]  # the models, by the fold that is left out
    weights: np.ndarray  # models x (terms, constant)
    balance: np.ndarray  # models x (negative, positive): what a post counts


def _sums(batches: Iterable[pa.RecordBatch], asked: _Pass) -> np.ndarray:
    """Sums over posts: models x (slopes by term, of the constant, loss)."""
    outs, weights, balance = asked
    size = weights.shape[1] - 1
    sums = np.zeros((len(outs), size + 2))
    for batch in batches:
        for i in range(batch.num_rows):
            y, fold, sizes, terms, values = (np.frombuffer(batch.column(batch.schema.names.index(c))[i].as_py(), t) for c, t in (("y", np.int8), ("fold", np.int8), ("sizes", np.int32), ("terms", np.int32), ("values", np.float64)))
            bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            cuts = np.unique(np.concatenate([np.searchsorted(bounds[:-1], np.arange(0, max(bounds[-1], 1), SLICE)), [len(y)]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own, value, n = terms[bounds[a] : bounds[b]].astype(np.int64), values[bounds[a] : bounds[b]], sizes[a:b]
                full = np.flatnonzero(n)
                first, n, t = bounds[a:b][full] - bounds[a], n[full], y[a:b]
                for m, out in enumerate(outs):
                    z = np.full(b - a, weights[m, size])
                    if len(full):
                        z[full] += np.add.reduceat(weights[m][own] * value, first)
                    s = np.where(fold[a:b] == out, 0.0, balance[m][t])
                    slope = s * (1 / (1 + np.exp(-z)) - t)
                    sums[m, :size] += np.bincount(own, value * np.repeat(slope[full], n), size)
                    sums[m, size:] += slope.sum(), (s * (np.logaddexp(0, z) - t * z)).sum()
    return sums


def _passed(blocks: DataFrame, asked: _Pass) -> np.ndarray:
    """``_sums`` of all blocks: tasks add up theirs, Spark adds up the tasks by term."""
    shared = blocks.sparkSession.sparkContext.broadcast(asked)
    names = [f"s{i}" for i in range(len(asked.outs))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _sums(batches, shared.value)
        told = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(told, pa.int64()), *(pa.array(x[told]) for x in sums)], ["place", *names])

    parts = blocks.mapInArrow(run, ", ".join(["place long", *(f"{c} double" for c in names)]))
    found = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in names]).toArrow()  # a row a term, and two
    total = np.zeros((len(names), asked.weights.shape[1] + 1))
    total[:, found.column("place").to_numpy()] = np.array([found.column(c).to_numpy() for c in names])
    shared.destroy()
    return total


class _Descent:
    """One model on its way to the least sum of losses and half the squared length of its weights, the constant apart."""

    def __init__(self, size: int) -> None:
        self.w, self.slope, self.steps = np.zeros(size + 1), np.zeros(size + 1), []
        self.tried, self.loss, self.part, self.down = self.w, np.inf, 1.0, 0.0

    def told(self, sums: np.ndarray) -> bool:
        """Takes the sums at ``tried``, and chooses what to try next; whether it is done."""
        free = self.tried.copy()
        free[-1] = 0
        loss, slope = sums[-1] + free @ free / 2, sums[:-1] + free
        if loss > self.loss + 1e-4 * self.part * self.down + 1e-13 * abs(self.loss):
            # too far: to the least of the parabola through both losses and the slope, within bounds
            least = -self.down * self.part / (2 * (loss - self.loss - self.down * self.part)) if np.isfinite(loss) else 0.1
            self.part *= min(max(least, 0.1), 0.5)
            self.tried = self.w + self.part * self.ahead
            return False
        s, d = self.tried - self.w, slope - self.slope
        if s @ d > 0:
            self.steps = [*self.steps, (s, d, 1 / (s @ d))][-MEMORY:]
        self.w, self.loss, self.slope, self.part = self.tried, loss, slope, 1.0
        if np.linalg.norm(slope) <= TOLERANCE:
            return True
        q, by = slope.copy(), []
        for s, d, r in reversed(self.steps):
            by.append(r * (s @ q))
            q -= by[-1] * d
        if self.steps:
            s, d, r = self.steps[-1]
            q /= r * (d @ d)
        for (s, d, r), x in zip(self.steps, reversed(by), strict=True):
            q += (x - r * (d @ q)) * s
        self.ahead, self.down = -q, -(q @ slope)
        self.tried = self.w + self.ahead
        return False


def _fitted(blocks: DataFrame, size: int, balance: dict[int, tuple[float, float]]) -> dict[int, np.ndarray]:
    """The weights of the models and, last, their constants. ``PASSES`` passes are an end that none should need."""
    models = {out: _Descent(size) for out in balance}
    left = list(models)
    for _ in range(PASSES):
        asked = _Pass(left, np.array([models[m].tried for m in left]), np.array([balance[m] for m in left]))
        sums = _passed(blocks, asked)
        left = [m for m, s in zip(left, sums, strict=True) if not models[m].told(s)]
        if not left:
            break
    return {out: m.w for out, m in models.items()}


def train(posts: DataFrame, min_df: int = 3, max_df: float = 0.9, size: int = SIZE) -> Model | None:
    """The models for marked posts, or None with under ``MIN_CLASS`` labelled posts of a class. Posts of under two tokens don't teach."""
    spark = posts.sparkSession
    known = posts.where(F.col("label").isNotNull() & (F.size("tokens") >= 2))
    counts = {(r["label"], r["fold"]): r["count"] for r in known.groupBy("label", "fold").count().collect()}  # two for each fold
    n = lambda label, out: sum(c for (x, f), c in counts.items() if x == label and f != out)
    if min(n("positive", None), n("negative", None)) < MIN_CLASS:
        return None
    vocabulary = factors.fit_vocabulary(known, "key", F.col("tokens"), min_df, max_df, size)
    size = vocabulary.count()
    balance = {}
    for out in (-1, *range(FOLDS)):
        p, q = n("positive", out), n("negative", out)
        if p and q:
            balance[out] = ((p + q) / 2 / q, (p + q) / 2 / p)
    made = cut(_blocks(known, vocabulary))
    terms = made.agg(F.sum("n")).first()[0]
    tasks = max(min(-(-terms // SLICE), spark.sparkContext.defaultParallelism), -(-terms // TASK), 1)
    blocks = made.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = _fitted(blocks, size, balance)
    finally:
        blocks.unpersist()
    table = [(np.full(size + 1, out, np.int32), np.append(np.arange(size, dtype=np.int32), np.int32(-1)), w) for out, w in fitted.items()]
    weights = pa.table([np.concatenate(c) for c in zip(*table, strict=True)], ["model", "place", "weight"])  # at most SIZE + 1 rows a model
    return Model(vocabulary, cut(spark.createDataFrame(weights)))


def _sum_by_model(posts: DataFrame, model: Model) -> DataFrame:
    """key, label, model, n_tokens, z: each post's sum of values and weights in its own model, with the constant (0 without a model)."""
    spark = posts.sparkSession
    told = model.weights.toArrow()  # at most SIZE + 1 rows a model
    which, place, weight = (told.column(c).to_numpy() for c in ("model", "place", "weight"))
    words = factors.lexicon(model.vocabulary)
    table = np.zeros((FOLDS + 1, len(words.idf) + 1))  # the model of all is the first one, the constant the last column
    table[which + 1, place] = weight
    shared = spark.sparkContext.broadcast((words, table))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = shared.value
        for b, row, term, value in factors.valued(batches, words):
            own = b.column(b.schema.names.index("model")).to_numpy(zero_copy_only=False) + 1
            z = table[own, -1] + np.bincount(row, value * table[own[row], term], b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in names), pa.array(z)], [*names, "z"])

    own = F.when(F.col("label").isNotNull(), F.col("fold")).otherwise(-1)
    rows = posts.select("key", "label", own.alias("model"), F.size("tokens").alias("n_tokens"), F.col("tokens").alias("w"))
    names = ["key", "label", "model", "n_tokens"]
    fields = [rows.schema["key"], rows.schema["label"], StructField("model", IntegerType()), StructField("n_tokens", IntegerType())]
    return rows.mapInArrow(run, StructType([*fields, StructField("z", DoubleType())]))


def scored(posts: DataFrame, model: Model | None) -> DataFrame:
    """key, label, model (the one that scored it; null for the lexicon's fallback), sentiment_score = p(+) - p(-), sentiment_label at
    0.20 either way, sentiment_confidence; posts of under two tokens are neutral. A marker decides where the label is neutral. Every row is
    scored by its own words, whatever its key."""
    if model is None:
        found = posts.withColumn("clean", F.array_join("tokens", " "))
        found = found.withColumns(rules.lexicon_score("clean")).withColumn("model", F.lit(None).cast("int")).drop("clean")
    else:
        p = 1 / (1 + F.exp(-F.col("z")))
        score = F.when(F.col("n_tokens") < 2, 0.0).otherwise(F.round(2 * p - 1, 4))
        found = _sum_by_model(posts, model).withColumn("sentiment_score", score)
        found = found.withColumn("sentiment_label", rules.polarity(F.col("sentiment_score"))).withColumn("sentiment_confidence", F.abs("sentiment_score"))
    out = found.withColumn("raw_score", F.col("sentiment_score")).withColumns(rules.explicit_override("sentiment_label", "sentiment_score", "sentiment_confidence", "label"))
    return out.select("key", "label", "model", "raw_score", "sentiment_score", "sentiment_label", "sentiment_confidence")


def holdout_quality(scored: DataFrame) -> DataFrame:
    """One row: labelled posts, accuracy and macro F1 of the sign of ``raw_score``, the score before markers decide."""
    hit = lambda p, t: F.count_if(F.when(F.col("raw_score") > 0, "positive").otherwise("negative").eqNullSafe(F.lit(p)) & (F.col("label") == t))
    tp, fp, fn, tn = hit("positive", "positive"), hit("positive", "negative"), hit("negative", "positive"), hit("negative", "negative")
    f1 = lambda a, b, c: 2 * a / F.greatest(2 * a + b + c, F.lit(1))
    known = scored.where(F.col("label").isNotNull())
    return known.agg(F.count("*").alias("labelled"), F.round((tp + tn) / F.greatest(F.count("*"), F.lit(1)), 4).alias("accuracy"), F.round((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2, 4).alias("macro_f1"))
