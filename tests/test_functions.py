from pyspark.sql import functions as F

from sieveline.functions import rules, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_text(spark):
    f = lambda c, t: one(spark, c(F.col("t")), t=t)
    assert f(text.training_text, "Buy $AAPL now! https://x.y/z @bob BULLISH 2x") == "buy now x"
    assert f(text.symbol_key, " brk-b ") == "BRK.B"
    assert f(text.clean_label, "🚀 é1 Top-10 (Tech) -") == "Top-10 (Tech)"
    assert f(text.clean_label, "") == "Unknown" and f(text.clean_label, None) == "Unknown"
    assert f(text.market_cap, "$36.73 B") == 36.73e9 and f(text.market_cap, "-") is None and f(text.market_cap, "1,234") == 1234
    assert f(text.ratio, "12,5%") == 12.5 and f(text.ratio, "1,234.5") is None and f(text.ratio, "") is None
    assert f(text.snippet, "a" * 200) == "a" * 179 + "…"
    assert f(text.clean_post, "See news.example.com/x try free  now") == "See now"
    assert f(text.json_object_text, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert f(text.title_phrase, "one two three four five") == "One Two Three Four"
    assert f(text.safe_number, "NaN") is None and f(text.safe_number, "1.23456") == 1.2346
    assert f(lambda c: text.json_array(c, "string"), "not json") == [] and f(lambda c: text.json_array(c, "string"), '["a"]') == ["a"]
    assert text.header_key("Return on Equity") == "returnonequity"


def test_rules(spark):
    f = lambda c, t: one(spark, c(F.col("t")), t=t)
    assert len(rules.SEED_STEMS) == len(set(rules.SEED_STEMS)) == 63
    assert f(rules.seed_matches, "Lawsuits and dilution; CEO said") == ["ceo", "dilut", "lawsuit"]
    assert f(rules.explicit_label, "so bullish") == "positive" and f(rules.explicit_label, "bullish or bearish") is None
    assert round(f(rules.category_prior, "Oil & Gas"), 4) == 0.3 and round(f(rules.category_prior, "Software"), 4) == 0.7
    assert f(lambda c: rules.lexicon_score(c)["sentiment_label"], "great growth strong win") == "positive"
    cls = lambda name, industry, category="x": one(spark, rules.instrument_class(F.col("n"), F.col("i"), F.col("c")), n=name, i=industry, c=category)
    assert cls("Acme", "Software") == "common_equity" and cls("iShares Gold", "x") == "fund_etf_trust" and cls("Acme Realty", "x", "REITs") == "reit"
    assert cls("Acme", "Investment Trusts or Mutual Funds") == "ambiguous" and cls("Acme", "-") == "ambiguous"


def test_fusion_formulas(spark):
    value = lambda cov, posts, n: one(spark, rules.profile_confidence(F.lit(cov), F.lit(posts), F.lit(n)), t="x")
    assert value(0.0, 10, 3) == 0 and value(0.5, 0, 3) == 0
    assert value(0.5, 100, 3) == 0.5 and value(1.0, 100, 4) == 1.0
    assert value(0.5, 10, 1) < value(0.5, 100, 1) < value(0.5, 100, 2)
    frames = F.from_json(F.lit('[{"label":"A","s":1},{"label":" a ","s":2},{"label":""},{"label":"B","s":3}]'), "array<struct<label:string,s:int>>")
    assert [f["s"] for f in one(spark, rules.merge_frames(frames), t="x")] == [1, 3]
    assert one(spark, rules.method_agreement([F.lit(True), F.lit(False), F.lit(True)], F.lit(True)), t="x") == 0.5


def test_seed_matches_of_stems_within_stems(spark):
    rows = spark.createDataFrame([("A sustainable VALUE valued",), ("unsustain sus", ), (None,), ("",)], "t string")
    got = [r[0] for r in rows.select(rules.seed_matches("t", ("value", "sustain", "sus", "val"))).collect()]
    assert got == [["sus", "sustain", "val", "value"], ["sus"], [], []]
