"""Posts to companies, topics, axes and fused profiles (AG, CL7, JN6, JN11, FU5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import clamp
from .lineage import cut
from .statistics import top_k


def exact_mean(column: str) -> Column:
    """Mean of values of four decimals, summed exactly, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,4)")).cast("double") / F.count(column)


def company_social(posts: DataFrame) -> DataFrame:
    """Counts, distinct authors, mean sentiment and label shares for each symbol; the mean is over rounded scores."""
    share = lambda label: F.round(F.count_if(F.col("sentiment_label") == label) / F.count("*"), 4)
    return posts.groupBy("symbol").agg(
        F.count("*").alias("posts_count"),
        F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("text_posts_count"),
        F.count_distinct(F.nullif("username", F.lit(""))).alias("authors_count"),
        F.round(exact_mean("sentiment_score"), 4).alias("avg_sentiment"),
        share("positive").alias("positive_share"), share("negative").alias("negative_share"), share("neutral").alias("neutral_share"),
    )


def social_scores(companies: DataFrame) -> DataFrame:
    """Controversy, coverage, author diversity and the proxy score; ``sector_norm_prior`` is given."""
    controversy = 4 * F.col("positive_share") * F.col("negative_share")
    coverage = F.least(F.lit(1.0), F.log1p("posts_count") / F.log(F.lit(41.0)))
    diversity = F.least(F.lit(1.0), 3 * F.col("authors_count") / F.greatest("posts_count", F.lit(1)))
    proxy = 100 * (0.45 * (F.col("avg_sentiment") + 1) / 2 + 0.25 * (1 - controversy) + 0.20 * F.col("sector_norm_prior") + 0.10 * coverage)
    return companies.withColumns({"controversy_score": F.round(controversy, 4), "coverage_score": F.round(coverage, 4), "author_diversity_score": F.round(diversity, 4), "custom_esg_proxy_score": F.round(proxy, 2)})


def topic_summary(assigned: DataFrame, cut: float = 0.08, top: int = 3) -> DataFrame:
    """doc_id, topic_id, weight, sentiment_score: over each post's strongest topics, the weight, mean sentiment and best examples of a topic."""
    best = top_k(assigned.where(F.col("weight") >= cut), ["doc_id"], top, F.col("weight").desc(), F.col("topic_id")).drop("rn")
    examples = top_k(best, ["topic_id"], 3, F.col("weight").desc(), F.col("doc_id")).groupBy("topic_id").agg(F.sort_array(F.collect_list("doc_id")).alias("examples"))
    sums = best.groupBy("topic_id").agg(F.round(F.sum("weight"), 6).alias("corpus_weight"), F.count("*").alias("posts_with_topic"), F.round(F.sum(F.col("weight") * F.col("sentiment_score")) / F.sum("weight"), 4).alias("average_sentiment"))
    return sums.join(examples, "topic_id")


def company_topics(assigned: DataFrame, least: float = 0.05) -> DataFrame:
    """symbol, topic_id: weight, posts, weighted sentiment, share of the company's weight, signed score."""
    exact = lambda c: F.sum(c.cast("decimal(26,12)"))  # noqa: E731  sums of decimals don't depend on the order of rows
    by = assigned.where(F.col("weight") >= least).groupBy("symbol", "topic_id").agg(exact(F.col("weight")).alias("exact"), F.count("*").alias("posts_with_topic"), exact(F.col("weight") * F.col("sentiment_score")).cast("double").alias("signed"))
    by = by.withColumn("w", F.col("exact").cast("double")).withColumn("s", F.col("signed") / F.col("w"))
    total = by.groupBy("symbol").agg(F.sum("exact").cast("double").alias("all"))
    share = F.col("w") / F.col("all")
    return by.join(total, "symbol").select("symbol", "topic_id", F.round("w", 4).alias("topic_weight_sum"), "posts_with_topic", F.round("s", 4).alias("avg_sentiment"), F.round(share, 6).alias("topic_share"), F.round(share * F.col("s"), 6).alias("signed_topic_score"))


def topic_exposure(labelled: DataFrame, axiological: list[int]) -> DataFrame:
    """symbol, topic_id (outliers are -1): posts, share of posts in value topics, and the share of each of those topics."""
    hit = F.col("topic_id").isin(axiological)
    by = labelled.groupBy("symbol", "topic_id").agg(F.count("*").alias("n"))
    out = by.groupBy("symbol").agg(F.sum("n").alias("post_count"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("axiological_count"), F.collect_list(F.when(hit, F.struct(F.col("topic_id").cast("string").alias("k"), F.col("n").alias("v")))).alias("pairs"))
    shares = F.map_from_entries(F.transform(F.sort_array("pairs"), lambda p: F.struct(p["k"].alias("key"), F.round(p["v"] / F.col("post_count"), 4).alias("value"))))
    return out.select("symbol", "post_count", "axiological_count", F.round(F.col("axiological_count") / F.col("post_count"), 4).alias("axiological_coverage"), shares.alias("topic_exposure"))


def family_catalog(axes: DataFrame, families: DataFrame) -> DataFrame:
    """axis_id, relevance, corpus_weight, average_sentiment by family (axis_id, family_id, family_label): weighted means and counts."""
    weight = F.greatest(F.lit(0.2), F.col("relevance") + F.least(F.lit(1.0), F.col("corpus_weight") / 2000))
    joined = axes.join(families, "axis_id").where("family_id is not null").withColumn("w", weight)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("w")) / F.sum("w"), 4)
    return joined.groupBy("family_id").agg(F.first("family_label").alias("family_label"), F.count("*").alias("axis_count"), F.round(F.sum("corpus_weight"), 4).alias("corpus_weight"), mean("relevance").alias("value_relevance"), mean("average_sentiment").alias("average_sentiment"))


def company_families(axes: DataFrame, families: DataFrame) -> DataFrame:
    """symbol, axis_id, raw, exposure, confidence, posts: weighted raw score, exposure up to 1, dims and posts of each family."""
    weight = F.greatest(F.lit(0.03), F.col("exposure")) * (0.25 + 0.75 * F.col("confidence"))
    joined = axes.join(families, "axis_id").where("family_id is not null").withColumn("w", weight)
    return joined.groupBy("symbol", "family_id").agg((F.sum(F.col("raw") * F.col("w")) / F.sum("w")).alias("raw"), F.least(F.lit(1.0), F.sum("exposure")).alias("exposure"), F.count("*").alias("dims"), F.sum("posts").alias("posts"))


def cluster_counts(axes: DataFrame) -> DataFrame:
    return axes.groupBy("cluster_id").agg(F.min("cluster_label").alias("cluster_label"), F.count("*").alias("axis_count"))


def frame_sentiment(frames: DataFrame, posts: DataFrame) -> DataFrame:
    """symbol, label ⋈ symbol, text, sentiment_score: mean over the posts that contain any word of the label."""
    words = F.filter(F.split(F.lower("label"), r"\s+"), lambda w: w != "")
    joined = frames.select("symbol", "label", words.alias("words")).join(posts, "symbol").where(F.exists("words", lambda w: F.contains(F.lower("text"), w)))
    return joined.groupBy("symbol", "label").agg(F.count("*").alias("n_posts"), F.round(exact_mean("sentiment_score"), 4).alias("sentiment"))


def fuse_profiles(filters: dict[str, DataFrame], model: DataFrame) -> DataFrame:
    """All symbols of any source: greatest coverage and posts, coverage of each filter, agreement, confidence, flags.

    ``filters``: name to (symbol, post_count, axiological_coverage); ``model``: (symbol, post_count, frames, error).
    """
    long = None
    for name, df in filters.items():
        part = df.select("symbol", "post_count", F.col("axiological_coverage").alias("cov"), F.lit(name).alias("source"))
        long = part if long is None else long.unionByName(part)
    by = long.groupBy("symbol").agg(F.max("post_count").alias("p1"), F.max("cov").alias("coverage"), *[F.max(F.when(F.col("source") == n, F.col("cov"))).alias(f"coverage_{n}") for n in filters])
    model = model.select("symbol", F.col("post_count").alias("p2"), rules.merge_frames("frames").alias("frames"), F.coalesce("error", F.lit(False)).alias("error"))
    both = by.join(model, "symbol", "full")
    frames = F.coalesce(F.size("frames"), F.lit(0))
    ok = F.col("error").isNotNull() & ~F.col("error")
    active = [F.coalesce(F.col(f"coverage_{n}") > 0, F.lit(False)) for n in filters] + [F.coalesce(ok & (frames > 0), F.lit(False))]
    methods = sum([a.cast("int") for a in active[1:]], active[0].cast("int"))
    out = both.select("symbol", F.greatest(F.coalesce("p1", F.lit(0)), F.coalesce("p2", F.lit(0))).alias("post_count"), F.coalesce("coverage", F.lit(0.0)).alias("axiological_coverage"), *[F.coalesce(f"coverage_{n}", F.lit(0.0)).alias(f"coverage_{n}") for n in filters], frames.alias("n_frames"), methods.alias("methods"), rules.method_agreement(active, ok).alias("agreement"))
    return out.withColumns({
        "confidence": rules.profile_confidence("axiological_coverage", "post_count", "methods"),
        "has_signal": (F.col("axiological_coverage") > 0.05) | (F.col("n_frames") > 0),
        "profile_null": (F.col("axiological_coverage") < 0.03) & (F.col("n_frames") == 0),
    })


def profile_summary(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.count("*").alias("companies"), F.count_if("has_signal").alias("with_signal"), F.count_if("profile_null").alias("null_profiles"), F.round(F.avg("axiological_coverage"), 4).alias("mean_coverage"), F.round(F.avg("agreement"), 4).alias("mean_agreement"))


def topic_quality(topics: DataFrame, generic: tuple[str, ...], domain: tuple[str, ...], noise: tuple[str, ...]) -> DataFrame:
    """topic_id, keywords, example_tokens (mean), posts_with_topic, average_sentiment: specificity, support and relevance."""
    n = F.greatest(F.size("keywords"), F.lit(1))
    tokens = lambda k: F.filter(F.split(F.lower(k), r"[^a-z]+"), lambda t: t != "")
    listed = lambda k, terms: F.forall(tokens(k), lambda t: F.array_contains(rules.words(terms), t))
    ratio = lambda test: F.size(F.filter("keywords", test)) / n
    gen, dom = ratio(lambda k: listed(k, generic + domain)), ratio(lambda k: F.contains(k, F.lit(".")) | ((F.size(tokens(k)) > 0) & listed(k, domain)))
    noisy, phrase = ratio(lambda k: (F.size(tokens(k)) == 0) | listed(k, noise + domain)), ratio(lambda k: F.contains(k, F.lit(" ")))
    spec = 0.38 * (1 - gen) + 0.16 * (1 - dom) + 0.16 * (1 - noisy) + 0.20 * F.least(F.lit(1.0), F.col("example_tokens") / 8) + 0.15 * phrase
    support = F.least(F.lit(1.0), F.log1p("posts_with_topic") / F.log1p(F.lit(3000.0)))
    strength = F.least(F.lit(1.0), F.abs("average_sentiment") * 2.5)
    relevance = clamp(0.52 * spec + 0.30 * support + 0.18 * strength - 0.30 * noisy)
    return topics.select("topic_id", F.round(clamp(spec), 4).alias("specificity"), F.round(support, 4).alias("support"), F.round(strength, 4).alias("sentiment_strength"), F.round(relevance, 4).alias("value_relevance"), F.round(gen, 4).alias("generic_ratio"), F.round(dom, 4).alias("domain_ratio"), F.round(noisy, 4).alias("noise_ratio"))


def select_topics(quality: DataFrame, target: int, floor: int = 24) -> DataFrame:
    """Adds ``chosen``: topics that pass the quality cuts, best first, refilled from the others up to ``floor``."""
    passes = (F.col("specificity") >= 0.22) & (F.col("domain_ratio") < 0.55) & (F.col("noise_ratio") < 0.50)
    ranked = top_k(quality.withColumn("passes", passes), [], 1 << 30, F.col("passes").desc(), F.col("value_relevance").desc(), F.col("support").desc(), F.col("topic_id"))
    return ranked.withColumn("chosen", (F.col("passes") & (F.col("rn") <= target)) | (F.col("rn") <= floor)).drop("rn")


#: A ticker in more categories than this has them dealt in blocks of about as many.
HOT_TICKER = 1000


def _category_pairs(members: DataFrame) -> DataFrame:
    """a, b, ticker: two categories (a < b) with a ticker in common. A hot ticker's categories are spread over blocks on one side and
    repeated for each block on the other, so that no task has all of its pairs."""
    m = members.select("category", "ticker").distinct()
    hot = cut(m.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") > HOT_TICKER).select("ticker", F.ceil(F.col("n") / HOT_TICKER).cast("int").alias("blocks")))
    if hot.isEmpty():
        spread, repeated = m.withColumn("block", F.lit(0)), m.withColumn("block", F.lit(0))
    else:
        dealt = m.join(hot, "ticker", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        spread = dealt.withColumn("block", F.pmod(F.xxhash64("category"), F.col("blocks")).cast("int"))
        repeated = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one, two = spread.select("ticker", "block", F.col("category").alias("a")), repeated.select("ticker", "block", F.col("category").alias("b"))
    return one.join(two, ["ticker", "block"]).where("a < b").select("a", "b", "ticker")


def category_overlaps(members: DataFrame, sample: int = 30) -> DataFrame:
    """a, b, shared, sample: tickers that each pair of categories (a < b) shares, with the first ``sample`` of them. The sample is a rank
    limited before its shuffle, so no pair's tickers are ever gathered whole."""
    pairs = _category_pairs(members)
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
    first = pairs.withColumn("rn", F.row_number().over(Window.partitionBy("a", "b").orderBy("ticker"))).where(F.col("rn") <= sample)
    told = first.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("sample"))
    return counted.join(told, ["a", "b"])


def category_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("category").agg(F.count_distinct("ticker").alias("tickers"))


def shared_tickers(members: DataFrame) -> DataFrame:
    by = members.groupBy("ticker").agg(F.array_sort(F.collect_set("category")).alias("c"))
    return by.where(F.size("c") >= 2).select("ticker", F.size("c").alias("categories"), F.array_join("c", ",").alias("slugs"))


def _greedy(edges: DataFrame) -> DataFrame:
    """dropped, kept: what one pass over the edges (a, b, less, big) in the order of ``rank`` drops, if an edge with a dropped end does
    nothing and any other one drops its ``less``. Done in rounds: an edge that comes first at both of its ends waits for nothing."""
    left, made = cut(edges), []
    while not left.isEmpty():
        first = left.select(F.explode(F.array("a", "b")).alias("v"), "rank").groupBy("v").agg(F.min("rank").alias("least"))
        at = lambda side: first.select(F.col("v").alias(side), F.col("least").alias(f"least_{side}"))
        ready = left.join(at("a"), "a").join(at("b"), "b").where((F.col("rank") == F.col("least_a")) & (F.col("rank") == F.col("least_b")))
        made.append(cut(ready.select(F.col("less").alias("dropped"), F.col("big").alias("kept"))))
        gone = made[-1].select("dropped")
        left = cut(left.join(gone, F.col("a") == F.col("dropped"), "left_anti").join(gone, F.col("b") == F.col("dropped"), "left_anti"))
    return reduce(DataFrame.union, made) if made else edges.select(F.col("less").alias("dropped"), F.col("big").alias("kept")).limit(0)


def redundant_categories(members: DataFrame, contained: float = 0.85, likeness: float = 0.60) -> DataFrame:
    """dropped, kept: a category contained in a larger one goes, then one like a larger one that is left (of equal sizes the
    alphabetically later one goes). Pairs are taken by the size of the larger category, falling, then by name."""
    sizes = cut(category_counts(members))
    size = lambda side: sizes.select(F.col("category").alias(side), F.col("tickers").alias(f"n_{side}"))
    pairs = _category_pairs(members).groupBy("a", "b").agg(F.count("*").alias("shared")).join(size("a"), "a").join(size("b"), "b")
    bigger = F.col("n_a") >= F.col("n_b")
    pairs = pairs.select("a", "b", "shared", "n_a", "n_b", F.when(bigger, F.col("a")).otherwise(F.col("b")).alias("big"), F.when(bigger, F.col("b")).otherwise(F.col("a")).alias("less"), F.struct((-F.greatest("n_a", "n_b")).alias("size"), "a", "b").alias("rank"))
    inside, like = F.col("shared") >= contained * F.least("n_a", "n_b"), F.col("shared") >= likeness * (F.col("n_a") + F.col("n_b") - F.col("shared"))
    near = cut(pairs.where(inside | like))
    first = cut(_greedy(near.where(inside)))
    gone = first.select("dropped")
    left = near.where(like).join(gone, F.col("a") == F.col("dropped"), "left_anti").join(gone, F.col("b") == F.col("dropped"), "left_anti")
    return first.union(_greedy(left))


def merge_report(merged: DataFrame, listed: DataFrame) -> DataFrame:
    """category, listed, matched, rate, with a total row (category null)."""
    by = listed.groupBy("category").agg(F.count("*").alias("listed")).join(merged.groupBy("category").agg(F.count("*").alias("matched")), "category", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    both = by.unionByName(by.agg(F.lit(None).cast("string").alias("category"), F.sum("listed").alias("listed"), F.sum("matched").alias("matched")))
    return both.withColumn("rate", F.round(F.col("matched") / F.col("listed"), 4))
