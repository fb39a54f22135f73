import random

from sieveline.operators import portfolio


def greedy(rows, p):
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    out, used = [], {}
    take = lambda r: (out.append(r), used.__setitem__(r[1], used.get(r[1], 0) + 1))
    if min(p.min_categories, p.size) > 1:
        for r in order:
            if len(out) < min(p.min_categories, p.size) and r[1] not in used:
                take(r)
    for r in order:
        if len(out) < p.size and r not in out and (p.max_per_category == 0 or used.get(r[1], 0) < p.max_per_category):
            take(r)
    for r in order:
        if len(out) < p.size and r not in out and not p.strict_category_limit:
            take(r)
    return out


def loop_weights(scores, cap):
    n = len(scores)
    if cap * n < 1:
        return [round(1 / n, 4)] * n
    left, open_, w = 1.0, set(range(n)), [0.0] * n
    while True:
        total = sum(scores[i] for i in open_)
        over = [i for i in open_ if left * scores[i] / total > cap + 1e-9]
        if not over:
            for i in open_:
                w[i] = left * scores[i] / total
            break
        for i in over:
            w[i] = cap
            open_.discard(i)
        left = 1 - cap * (n - len(open_))
    w = [round(x, 4) for x in w]
    w[0] = round(w[0] + 1 - sum(w), 4)
    return w


def test_pick_and_weights_equal_the_loops(spark):
    random.seed(4)
    for trial in range(6):
        rows = [(f"S{i:02}", random.choice("ABCD"), round(random.random(), 2)) for i in range(random.choice((3, 12, 25)))]
        p = portfolio.Profile(size=random.choice((1, 5, 8)), max_per_category=random.choice((0, 1, 2)), min_categories=random.choice((1, 3)), strict_category_limit=trial % 2 == 0, weighting_mode="score_weighted", max_holding_weight=random.choice((0.15, 0.3)))
        df = spark.createDataFrame(rows, "symbol string, category string, selection_score double")
        got = portfolio.weighted(portfolio.pick(df, p), p).orderBy("position").collect()
        seeds = min(p.min_categories, p.size) if min(p.min_categories, p.size) > 1 else 0
        want = greedy(rows, p)
        assert {r["symbol"] for r in got} == {r[0] for r in want} and [r["symbol"] for r in got][:seeds] == [r[0] for r in want][:seeds]
        weights = loop_weights([max(r["selection_score"], 0.0001) for r in got], p.max_holding_weight)
        assert all(abs(r["weight"] - w) < 2e-4 for r, w in zip(got, weights, strict=True))


def test_filters_and_equal_weights(spark):
    df = spark.createDataFrame([("A", "x", "reit", 9, None), ("B", "x", "common_equity", 9, 10.0), ("C", "y", "ambiguous", 9, 1.0), ("D", "y", "common_equity", 1, 1.0)], "symbol string, category string, instrument_universe string, posts_count int, t double")
    pick = lambda **k: sorted(r["symbol"] for r in portfolio.candidates(df, portfolio.Profile(**k)).collect())
    assert pick() == ["A", "B"] and pick(universes=()) == [] and pick(bounds={"t": (5, None, False)}) == ["B"] and pick(categories=("y",), min_posts=0) == ["D"]
    assert portfolio.normal_weights(dict.fromkeys(portfolio.COMPONENTS, 0.0)) == portfolio.normal_weights(portfolio.DEFAULT_WEIGHTS)
