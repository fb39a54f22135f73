"""Closed itemsets of baskets with their rules, breadth first.

A closed itemset is one that no further item joins without losing support. Each has one generator: starting from a closed set,
an item greater than its last generating item is added, the items that all baskets of the new set hold are absorbed (full
support), and the child is kept only if no absorbed item is smaller than the one added (the prefix is preserved). So every
closed set is reached once, without a table of those seen. One level is a few Spark jobs: the occurrences (set, basket) of the
frontier are joined to the baskets, items are counted for each set, closures and children are read from the counts, the children's
occurrences are those rows of the same join, and the level is checkpointed.

Long baskets. A basket of n frequent items would give n rows for each frontier set, n * n at the first level. At most
``minimum - 1`` baskets, the longest ones, are set aside as *heavy* (a power of two of at least ``LIGHT`` items is the bound; it is
raised until so few are longer). A set of enough support then stands in a light basket as well, so the light ones alone give every
pair of set and item that can matter; only pairs whose light count can still reach the minimum are looked up in the heavy
baskets. Counts are exact, and the rows made are at most ``bound`` times the rows of the frontier.

What is broadcast. Supports of frequent items: each stands in at least a ``share``-th of all baskets, so there are at most
``share`` times the mean basket of them, whatever the input; they, a level's sets and children and the heavy baskets' items are counted
first and joined by a shuffle beyond ``BROADCAST_ROWS``. To the driver go counts only, and the items that stand in all baskets (no more than the shortest basket).

Rows. Null baskets or items take no part; rows that repeat a basket and an item are one; an empty table gives no sets; further
columns are not read, whatever their names. All baskets count for the minimum, also those without a frequent item. Ties of
rules are broken by the smaller item.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import cut

LIGHT = 64
BROADCAST_ROWS = 200_000


class Baskets:
    """Counted baskets: ``total``, the ``minimum`` support, frequent items with their supports, and light and heavy baskets."""

    def __init__(self, lines: DataFrame, basket: str, item: str, least: int, share: int) -> None:
        keys = lines.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
        pairs = keys.distinct().persist(StorageLevel.DISK_ONLY)  # lost blocks are computed again
        self.parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.total = pairs.select("basket").distinct().count()
        self.minimum = max(least, -(-self.total // share))
        self.items = cut(pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= self.minimum))
        self.n_items = self.items.count()
        kept = pairs.join(few(self.items.select("item"), self.n_items), "item").select("basket", "item").repartition(self.parts, "basket")
        made = kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
        arrays = cut(made)  # dealt by basket, which a later join with it makes use of
        pairs.unpersist()
        bounds = [LIGHT << k for k in range(40)]
        longer = arrays.agg(*[F.coalesce(F.sum((F.size("items") > b).cast("long")), F.lit(0)) for b in bounds]).first()
        self.bound, self.n_heavy = next((b, n) for b, n in zip(bounds, longer, strict=True) if n < self.minimum)
        self.light = arrays.where(F.size("items") <= self.bound)
        self.heavy = arrays.where(F.size("items") > self.bound).select("basket", F.explode("items").alias("item"))
        self.heavy_rows = self.heavy.count() if self.n_heavy else 0
        self.everywhere = sorted(r[0] for r in self.items.where(F.col("support") == self.total).select("item").collect())

    def light_rows(self, occurrences: DataFrame) -> DataFrame:
        """(key, basket, items) for the light occurrences of a frontier."""
        return self.light.hint("merge").join(occurrences, "basket").select("key", "basket", "items")

    def with_heavy(self, counts: DataFrame, occurrences: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        """Counts (key, item, n) of light baskets, brought to those of all baskets; those under the minimum go. ``occurrences``: (key,
        basket) in heavy baskets. Also (key, item, basket): the heavy baskets found for what could still reach the minimum."""
        open_ = counts.where(F.col("n") >= self.minimum - self.n_heavy)
        if occurrences is None:
            return open_, None
        open_ = cut(open_)
        n = open_.count()
        asked = occurrences.join(few(open_.select("key", "item"), n), "key")
        found = cut(asked.join(few(self.heavy, self.heavy_rows), ["basket", "item"]).select("key", "item", "basket"))
        held = found.groupBy("key", "item").agg(F.count("*").alias("held"))  # no more rows than ``open_``
        total = F.col("n") + F.coalesce("held", F.lit(0))
        return open_.join(few(held, n), ["key", "item"], "left").select("key", "item", total.alias("n")).where(F.col("n") >= self.minimum), found


def few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast up to a counted number of rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _nodes(counts: DataFrame) -> DataFrame:
    """Closed sets from the counts (key, item, n) of a frontier: key, items, support and children (item, n). The last item of a key
    is the one that was added to the closed set before it."""
    one = counts.groupBy("key").agg(F.collect_list(F.struct("item", "n")).alias("seen"))
    added, prefix = F.element_at("key", -1), F.slice("key", 1, F.size("key") - 1)
    one = one.withColumn("added", added).withColumn("support", F.filter("seen", lambda x: x["item"] == F.col("added"))[0]["n"])
    full = F.array_sort(F.transform(F.filter("seen", lambda x: x["n"] == F.col("support")), lambda x: x["item"]))
    one = one.withColumn("items", full).where(~F.exists(F.array_except("items", prefix), lambda x: x < F.col("added")))
    children = F.filter("seen", lambda x: (x["item"] > F.col("added")) & (x["n"] < F.col("support")))
    return one.select("key", "items", "support", children.alias("children"))


def _children(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(key, item, child) of a level and their number."""
    n = nodes.agg(F.coalesce(F.sum(F.size("children").cast("long")), F.lit(0))).first()[0]
    out = nodes.select("key", "items", F.explode("children.item").alias("item"))
    return out.select("key", "item", F.concat("items", F.array("item")).alias("child")), n


def _pairs(baskets: DataFrame) -> DataFrame:
    """(basket, item, other): two items of a light basket, the smaller one first."""
    at = baskets.select("basket", "items", F.posexplode("items").alias("at", "item"))
    rest = F.slice("items", F.col("at") + 2, F.size("items"))
    return at.where(F.col("at") + 1 < F.size("items")).select("basket", "item", F.explode(rest).alias("other"))


def closed_itemsets(b: Baskets) -> DataFrame:
    """items (ascending) and support of every non-empty closed itemset of at least the minimum."""
    root = F.array(*[F.lit(x) for x in b.everywhere]).cast("array<bigint>")
    one = lambda c: F.concat(root, F.array(c))
    # The first level: the frontier's occurrences are the baskets themselves, and a pair counts for both of its items.
    pairs = _pairs(b.light)
    counts = pairs.groupBy("item", "other").agg(F.count("*").alias("n"))
    first = counts.select(F.col("item").alias("key"), F.col("other").alias("item"), "n")
    first, found = b.with_heavy(first, b.heavy.select(F.col("item").alias("key"), "basket") if b.n_heavy else None)
    first = cut(first)
    own = b.items.select(F.col("item").alias("key"), "item", F.col("support").alias("n"))
    both = first.union(first.select("item", "key", "n")).union(own)
    starts = both.where(~F.array_contains(root, F.col("key"))) if b.everywhere else both
    nodes = cut(_nodes(starts.select(one(F.col("key")).alias("key"), "item", "n")))
    children, n = _children(nodes)
    rows = pairs.select(one(F.col("item")).alias("key"), F.col("other").alias("item"), "basket")
    heavy = found.select(one(F.col("key")).alias("key"), "item", "basket") if found is not None else None
    levels = [nodes.select("items", "support")]
    while n:
        grown = rows.join(few(children, n), ["key", "item"]).select(F.col("child").alias("key"), "basket")
        occurrences = cut(grown.repartition(b.parts, "basket"))
        if heavy is not None:
            heavy = heavy.join(few(children, n), ["key", "item"]).select(F.col("child").alias("key"), "basket")
        rows = b.light_rows(occurrences).select("key", "basket", F.explode("items").alias("item"))
        counts, heavy = b.with_heavy(rows.groupBy("key", "item").agg(F.count("*").alias("n")), heavy)
        nodes = cut(_nodes(counts))
        levels.append(nodes.select("items", "support"))
        children, n = _children(nodes)
    if b.everywhere:
        whole = b.items.where(F.col("support") == b.total).groupBy().agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("support").alias("support"))
        levels.append(whole.where(F.size("items") > 0))
    return reduce(DataFrame.union, levels)


def rules(sets: DataFrame, n_sets: int, b: Baskets, confidence: int) -> DataFrame:
    """(items, item, rest_support, item_support): an item that follows from the others of a closed set, in at least ``confidence``
    per cent of their baskets and more often than by chance. The others are returned themselves, or else have the set's own closure
    and so its support."""
    parts = sets.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("item"))
    parts = parts.withColumn("rest", F.array_except("items", F.array("item")))
    known = sets.select(F.col("items").alias("rest"), F.col("support").alias("known"))
    found = parts.join(few(known, n_sets), "rest", "left").withColumn("rest_support", F.coalesce("known", "support"))
    single = few(b.items.select("item", F.col("support").alias("item_support")), b.n_items)
    often: Column = F.col("support") * 100 >= F.col("rest_support") * confidence
    return found.join(single, "item").where(often & (F.col("support") * F.lit(b.total) > F.col("rest_support") * F.col("item_support"))).select("items", "item", "rest_support", "item_support")


def itemset_report(lines: DataFrame, basket: str, item: str, least: int = 5, share: int = 20_000, confidence: int = 60) -> DataFrame:
    """Each closed itemset with its rules, counted and as a digest."""
    b = Baskets(lines, basket, item, least, share)
    sets = cut(closed_itemsets(b))
    n_sets = sets.count()
    r = F.struct("item", "rest_support", "item_support")
    found = rules(sets, n_sets, b, confidence).groupBy("items").agg(F.count("*").alias("n_rules"), F.min_by("item", F.struct("rest_support", "item")).alias("best_item"), F.array_sort(F.collect_list(r)).alias("r"))
    told = F.concat_ws(";", F.transform("r", lambda x: F.concat_ws(":", x["item"].cast("string"), x["rest_support"].cast("string"), x["item_support"].cast("string"))))
    out = sets.join(few(found, n_sets), "items", "left")
    return out.select(
        F.concat_ws(",", F.transform("items", lambda x: x.cast("string"))).alias("items"), F.size("items").cast("long").alias("n_items"), "support",
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "best_item", F.sha2(F.coalesce(told, F.lit("")), 256).alias("rules_sha256"),
    )
