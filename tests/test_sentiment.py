"""Cross-fitted sentiment: every model is the optimum of its own rows, and no post is scored by one that saw it."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import sentiment


@pytest.fixture(scope="module")
def posts():
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}x" for i in range(25)]
    rows = []
    for i in range(400):
        kind = rng.choice(["bullish", "bearish", "", "both"])
        pool = words[:16] if kind == "bullish" else words[9:] if kind == "bearish" else words
        body = [rng.choice(pool) for _ in range(rng.randint(1, 9))]
        mark = {"both": ["bullish", "bearish"], "": []}.get(kind, [kind.upper()])
        rows.append((i, " ".join(body + mark) + (" http://x.com/bearish $ABC" if i % 5 == 0 else "")))
    return rows + [(900, None), (901, ""), (902, "bullish"), (903, "zzz qqq unknown"), (904, "wax " * 3000 + "bullish")]


def plain_tokens(t):
    t = (t or "").strip().lower()
    for p in (r"https?://\S+", r"\$[A-Za-z][A-Za-z0-9.\-]*", r"@[A-Za-z0-9_]+", r"\bbullish\b", r"\bbearish\b", r"[^a-z\s]", r"\s+"):
        t = re.sub(p, " ", t)
    return [w for w in re.findall("[a-z]{2,}", t) if w not in ("bullish", "bearish")]


def plain_features(rows, known):
    grams = {i: collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in rows.items()}
    df = collections.Counter(g for i in known for g in grams[i])
    kept = sorted(g for g, n in df.items() if n >= 3 and n <= 0.9 * len(known))
    x = {}
    for i, g in grams.items():
        v = np.array([(1 + math.log(g[t])) * (math.log((1 + len(known)) / (1 + df[t])) + 1) if g[t] else 0.0 for t in kept])
        x[i] = v / (np.linalg.norm(v) or 1.0)
    return kept, x


def test_models_are_optima_and_scores_are_out_of_fold(spark, posts):
    df = spark.createDataFrame(posts, "id long, text string")
    made = sentiment.marked(df, "id", "text")
    info = {r["key"]: r for r in made.collect()}
    tokens = {i: plain_tokens(t) for i, t in posts}
    assert {i: r["tokens"] for i, r in info.items()} == tokens
    known = [i for i, r in info.items() if r["label"] and len(tokens[i]) >= 2]
    model = sentiment.train(made)
    kept, x = plain_features(tokens, known)
    vocabulary = {r["place"]: r["term"] for r in model.vocabulary.collect()}
    assert [vocabulary[i] for i in range(len(kept))] == kept
    weights = collections.defaultdict(lambda: np.zeros(len(kept) + 1))
    for r in model.weights.collect():
        weights[r["model"]][r["place"]] = r["weight"]  # the constant at -1 is the last one
    assert set(weights) == {-1, 0, 1, 2, 3, 4}
    for out, w in weights.items():
        rows = [i for i in known if info[i]["fold"] != out]
        y = np.array([info[i]["label"] == "positive" for i in rows], float)
        s = np.where(y == 1, len(rows) / 2 / y.sum(), len(rows) / 2 / (1 - y).sum())
        m = np.array([x[i] for i in rows])
        p = 1 / (1 + np.exp(-(m @ w[:-1] + w[-1])))
        assert np.abs(w[:-1] + m.T @ (s * (p - y))).max() < 2e-3 and abs((s * (p - y)).sum()) < 2e-3
    got = {r["key"]: r for r in sentiment.scored(made, model).collect()}
    assert len(got) == len(posts)
    for i, r in got.items():
        own = info[i]["fold"] if info[i]["label"] else -1
        score = 0.0 if len(tokens[i]) < 2 else 2 / (1 + math.exp(-(x[i] @ weights[own][:-1] + weights[own][-1]))) - 1
        assert r["model"] == own and abs(r["raw_score"] - score) < 1e-4
        neutral = abs(r["raw_score"]) <= 0.20
        assert r["sentiment_label"] == (info[i]["label"] or "neutral" if neutral else "positive" if r["raw_score"] > 0 else "negative")
        assert r["sentiment_confidence"] == (max(abs(r["raw_score"]), 0.75) if neutral and info[i]["label"] else abs(r["raw_score"]))
    labelled = [i for i in got if info[i]["label"]]
    hit = {(t, p): sum((info[i]["label"] == "positive") == t and (got[i]["raw_score"] > 0) == p for i in labelled) for t in (True, False) for p in (True, False)}
    f1 = [2 * hit[c, c] / (2 * hit[c, c] + hit[c, not c] + hit[not c, c]) for c in (True, False)]
    quality = sentiment.holdout_quality(sentiment.scored(made, model)).first()
    assert quality["labelled"] == len(labelled) and abs(quality["accuracy"] - (hit[True, True] + hit[False, False]) / len(labelled)) < 1e-4 and abs(quality["macro_f1"] - sum(f1) / 2) < 1e-4
    assert quality["accuracy"] > 0.8


def test_few_labels_fall_back_to_the_lexicon(spark, posts):
    few = sentiment.marked(spark.createDataFrame(posts[:30], "id long, text string"), "id", "text")
    assert sentiment.train(few) is None
    rows = sentiment.scored(few, None).collect()
    assert len(rows) == 30 and all(r["model"] is None for r in rows) and any(r["sentiment_confidence"] >= 0.75 for r in rows)
    assert sentiment.scored(few.limit(0), None).count() == 0


def test_the_queries_score_every_document(spark, sf_dir):
    from sieveline.plans import catalog

    assert catalog.queries()["ml4_sentiment_model"](spark, sf_dir).count() == 1000
    row = catalog.queries()["ml3_holdout_quality"](spark, sf_dir).first()
    assert row["labelled"] > 100 and row["accuracy"] > 0.75 and row["macro_f1"] > 0.7


def test_rows_that_share_a_key_are_scored_by_their_own_words(spark, posts):
    doubled = [*posts, (3, posts[7][1]), (None, posts[9][1])]
    made = sentiment.marked(spark.createDataFrame(doubled, "id long, text string"), "id", "text")
    model = sentiment.train(made)
    one = sentiment.marked(spark.createDataFrame([(1000 + i, t) for i, (_, t) in enumerate(doubled)], "id long, text string"), "id", "text")
    alone = {r["key"] - 1000: r for r in sentiment.scored(one.withColumn("fold", F.lit(0)), model).collect()}
    got = collections.defaultdict(list)
    for r in sentiment.scored(made.withColumn("fold", F.lit(0)), model).collect():
        got[r["key"]].append((r["model"], r["raw_score"]))
    assert len(alone) == len(doubled) == sum(map(len, got.values()))
    for key in (3, 7, None, 9):
        assert sorted(got[key]) == sorted((alone[i]["model"], alone[i]["raw_score"]) for i, (k, _) in enumerate(doubled) if k == key)


def test_all_models_share_passes(spark, posts):
    """A few jobs for each pass, and a fit at the optimum to four places whatever the number of posts."""
    many = [(i, t) for k in range(20) for i, t in ((1000 * k + i, t) for i, t in posts)]
    made = sentiment.marked(spark.createDataFrame(many, "id long, text string"), "id", "text")
    sc = spark.sparkContext
    sc.setJobGroup("fit", "")
    try:
        model = sentiment.train(made)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("fit")) < 150
    rows = [r for r in made.collect() if r["label"] and len(r["tokens"]) >= 2]
    kept, x = plain_features({i: r["tokens"] for i, r in enumerate(rows)}, range(len(rows)))
    m, y = np.array([x[i] for i in range(len(rows))]), np.array([r["label"] == "positive" for r in rows], float)
    w = np.zeros(len(kept) + 1)
    for r in model.weights.where("model = -1").collect():
        w[r["place"]] = r["weight"]
    s = np.where(y == 1, len(rows) / 2 / y.sum(), len(rows) / 2 / (1 - y).sum())
    slope = s * (1 / (1 + np.exp(-(m @ w[:-1] + w[-1]))) - y)
    assert np.linalg.norm(np.append(w[:-1] + m.T @ slope, slope.sum())) < 2e-4
