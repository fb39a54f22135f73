"""Personal data by bootstrapped contextual extraction (operator 1). DataFrame functions only.

Seeds are what four fixed patterns find (email, ip, card, phone), leftmost and non-overlapping for each kind, and, for secrets,
candidates that are long hexadecimal numbers. A candidate is a run without white space, less the punctuation around it, of at least
LEAST characters, with a digit or an at sign, that touches no span of the four patterns. Each occurrence has up to three lexical
patterns: the two words before it, the one before and the one after, the two after (in lower case, digits as 0, without the
punctuation around them, and as far as they lie within CONTEXT_CHARS characters and before the next identifier).

Patterns and values form a graph that is scored in rounds, until a round finds nothing new: a pattern's confidence in a kind is the
share of its distinct values known to be of that kind (with at least MIN_SUPPORT of them), a value's is the noisy-or of its
patterns, and values above MIN_CONFIDENCE that look like their kind (SHAPES) count as known from then on. At the end, occurrences
of those values become spans too, whatever words stand around them. Spans of the four patterns always stay; a hexadecimal number
is a secret only if a pattern says so. Offsets are code points, the end exclusive.

Nulls: a null text counts as empty, a null doc_id is handed through. Rows that repeat doc_id and text get equal results. Texts of any
length are searched whole; a row holds its spans as arrays that are built in chunks, so that work grows with their number. Only doc_id
and text are read for finding; a table's other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tools import cut

KINDS = ("email", "ip", "card", "phone")
#: Kinds of all spans, in order: those of the fixed patterns, then what only the method finds.
ALL_KINDS = (*KINDS, "secret")

#: The fixed patterns; look-behinds and possessive repeats keep them linear on long runs without changing what they match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A token that could be an identifier: it holds a digit, @ or (at), and has at least six characters.
CANDIDATE_SIGN = r"[0-9@]|[(\[]at[)\]]"
CANDIDATE = rf"(?<!\S)(?=\S*?(?:{CANDIDATE_SIGN}))\S++"
#: A candidate that is a seed of secrets.
SECRET_SEED = "^(?=[^0-9]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: What a value behind a pattern must look like to be of a kind.
SHAPES = {
    "email": r"^[^@\s]+(?:@|\(at\)|\[at\])[^@\s]+$",
    "ip": r"^[0-9A-Fa-f]{0,4}(?:[.:][0-9A-Fa-f]{0,4}){3,}$",
    "card": r"^(?:[^0-9]?[0-9]){12,19}$",
    "phone": r"^[+(]?[0-9](?:[().-]*[0-9]){6,14}$",
    "secret": r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_.+/=-]{16,}$",
}
LEADING = r"""^(?:[\["'<{,;.!?«“‘#$%&*|]|\((?![^()]*\)))*"""
TRAILING = r"""(?:[.,;!?"'>\]})»”’#$%&*|]|(?<!:):)+$"""
LEAST = 6
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.75
CONTEXT_CHARS = 256
#: Spans that are gathered together.
CHUNK = 128

_FOUND = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
_SPAN = "array<struct<start:bigint,end:bigint,value:string,contexts:array<string>>>"


def _folded(items: Column, state: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step`` (state, item -> new state, array of results) gives over an array, in order; gathered in chunks, for an array
    that grows by one is copied each time. ``items`` must be a column of the frame: an expression would be computed for each chunk."""

    def chunk(a: Column, k: Column) -> Column:
        def one(b: Column, x: Column) -> Column:
            new, out = step(b["state"], x)
            return F.struct(new.alias("state"), F.concat(b["out"], out).alias("out"))

        start = F.struct(a["state"].alias("state"), empty.alias("out"))
        return F.aggregate(F.slice(items, k * CHUNK + 1, CHUNK), start, one, lambda b: F.struct(b["state"].alias("state"), F.concat(a["out"], b["out"]).alias("out")))

    chunks = F.filter(F.sequence(F.lit(0), F.ceil(F.size(items) / CHUNK).cast("int")), lambda k: k * CHUNK < F.size(items))
    return F.aggregate(chunks, F.struct(state.alias("state"), empty.alias("out")), chunk, lambda a: a["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    reverse = F.reverse(_digits(value))

    def digit(i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(reverse)), F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _checks(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["value"])


def _bare(kind: str, spans: Column, only: bool = False) -> Column:
    """start, end, kind of the spans; ``only``: of those that are of this kind."""
    spans = F.filter(spans, lambda x: x["kind"] == kind) if only else spans
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _hint(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def _words(text: Column) -> Column:
    """The words of a short text as patterns have them."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"(?<!\S)[^\p{L}\p{N}\s]+(?=[\p{L}\p{N}])|(?<=[\p{L}\p{N}])[^\p{L}\p{N}\s]+(?!\S)", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def _with_contexts(spans: Column) -> Column:
    """Patterns instead of the text before and after: <two words before, <one before|one after>, two after>; those that lack a word are left out."""

    def patterns(x: Column) -> Column:
        left, right = x["left"], x["right"]
        last, first = F.element_at(left, -1), F.get(right, F.lit(0))
        two = F.when(F.size(left) > 1, F.concat(F.lit("<"), F.element_at(left, -2), F.lit(" "), last))
        around = F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(F.lit("<"), last, F.lit("|"), first, F.lit(">")))
        behind = F.when(F.size(right) > 1, F.concat(first, F.lit(" "), F.get(right, F.lit(1)), F.lit(">")))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.array_compact(F.array(two, around, behind)).alias("contexts"))

    cut_up = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _words(x["before"]).alias("left"), _words(x["after"]).alias("right")))
    return F.transform(cut_up, patterns)


def _step(a: Column, x: Column) -> tuple[Column, Column]:
    """The next match: where it stands, and the text around it."""
    start, before = a["at"] + F.length(x["part"]), F.right(F.concat(a["tail"], F.right(x["part"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))
    end = start + F.length(x["value"])
    span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), before.alias("before"), F.left(x["next"], F.lit(CONTEXT_CHARS)).alias("after"))
    return F.struct(end.alias("at"), F.right(F.concat(before, F.right(x["value"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS)).alias("tail")), F.array(span)


def _trimmed(span: Column) -> Column:
    """A candidate without the punctuation around it; a bracket with its partner inside stays."""
    value = F.regexp_replace(span["value"], TRAILING, "")
    lead = F.length(F.regexp_extract(value, LEADING, 0)).cast("long")
    return F.struct((span["start"] + lead).alias("start"), (span["start"] + F.length(value)).alias("end"), F.substring(value, lead.cast("int") + 1, F.length(value)).alias("value"), span["before"].alias("before"), span["after"].alias("after"))


def _spans(df: DataFrame, name: str, pattern: str, hint: Column, keep: Callable[[Column], Column], change: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds a column ``name``: the spans of ``pattern`` in the column t, after ``change``, that ``keep`` accepts."""
    df = df.withColumn("m", F.when(hint, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))
    df = df.withColumn("s", F.when(F.size("m") > 0, F.split("t", pattern, -1)))
    item = lambda i: F.struct(F.get("s", i).alias("part"), F.get("m", i).alias("value"), F.get("s", i + 1).alias("next"))
    df = df.withColumn("i", F.when(F.col("s").isNotNull(), F.transform(F.sequence(F.lit(0), F.size("m") - 1), item)))
    df = df.withColumn("f", _folded(F.col("i"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail")), F.array().cast(_FOUND), _step))
    df = df.withColumn("f", F.filter(F.transform("f", change) if change else F.col("f"), keep))
    return df.withColumn(name, F.coalesce(F.when(F.col("i").isNotNull(), _with_contexts(F.col("f"))), F.array().cast(_SPAN))).drop("m", "s", "i", "f")


def seeds(docs: DataFrame) -> DataFrame:
    """id, h (hash of the text), one array of spans for each kind of fixed pattern, and ``others``: runs that may be identifiers."""
    df = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    for kind in KINDS:
        df = _spans(df, kind, PATTERNS[kind], _hint(kind, F.col("t")), _checks(kind))
    df = _spans(df, "others", CANDIDATE, F.col("t").rlike(CANDIDATE_SIGN), lambda x: x["end"] - x["start"] >= LEAST, _trimmed)
    return df.select("id", F.xxhash64("t").alias("h"), *KINDS, "others")


def _candidates(found: DataFrame) -> DataFrame:
    """id, h, start, end, value, contexts of the runs in ``others`` that touch no span of the fixed patterns."""
    some = found.where(F.size("others") > 0).select("id", "h", "others", F.concat(*KINDS).alias("known")).dropDuplicates(["id", "h"])
    mark = lambda c, own: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), x["value"].alias("value"), x["contexts"].alias("contexts")))
    rows = some.select("id", "h", F.inline(F.concat(mark("others", True), mark("known", False))))
    # spans of one text, in order: the furthest end of a known one that starts no later, the nearest start of one that starts no earlier
    up, down = (Window.partitionBy("id", "h").orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow) for c in (F.col("start"), F.col("start").desc()))
    until = F.max(F.when(~F.col("own"), F.col("end"))).over(up)
    later = F.min(F.when(~F.col("own"), F.col("start"))).over(down)
    touched = F.coalesce(until > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))
    return rows.withColumn("touched", touched).where("own and not touched").select("id", "h", "start", "end", "value", "contexts")


def _known(graph: DataFrame, new: DataFrame | None) -> DataFrame:
    """v, kind, trust of the values known so far, the seeds and what rounds have found."""
    first = graph.where("seed is not null").select(F.col("value").alias("v"), F.col("seed").alias("kind"), F.lit(1.0).alias("trust"))
    every = first if new is None else first.unionByName(new.select(F.col("value").alias("v"), "kind", "trust"))
    return every.groupBy("v").agg(F.max(F.struct("trust", "kind")).alias("b")).select("v", "b.kind", "b.trust")


def discovered(found: DataFrame) -> DataFrame:
    """id, h, more: spans (kind, start, end) that high-confidence patterns add to the seeds. ``found``: from ``seeds``, cut."""
    others = cut(_candidates(found))
    edges = others.select("value", F.when(F.col("value").rlike(SECRET_SEED), "secret").alias("kind"), F.explode("contexts").alias("pattern"))
    for kind in KINDS:
        edges = edges.unionByName(found.select(F.explode(kind).alias("x")).select("x.value", F.lit(kind).alias("kind"), F.explode("x.contexts").alias("pattern")))
    graph = cut(edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed")))
    fits = F.coalesce(*[F.when((F.col("pattern_kind") == k) & F.col("value").rlike(SHAPES[k]), F.lit(True)) for k in ALL_KINDS], F.lit(False))
    open_ones = graph.where("seed is null or seed = 'secret'")
    new, seen = None, -1
    while True:
        state = graph.join(_known(graph, new), F.col("value") == F.col("v"), "left")
        mass = [F.struct((F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("trust"))), F.lit(0.0)) / F.count("*")).alias("score"), F.count_if(F.col("kind") == k).alias("support"), F.lit(k).alias("kind")) for k in ALL_KINDS]
        patterns = state.groupBy("pattern").agg(F.array_max(F.array(*mass)).alias("best"))
        patterns = patterns.where((F.col("best.score") >= MIN_CONFIDENCE) & (F.col("best.support") >= MIN_SUPPORT)).select(F.col("pattern").alias("p"), F.col("best.kind").alias("pattern_kind"), F.col("best.score").alias("score"))
        hits = open_ones.join(patterns, F.col("pattern") == F.col("p")).where(fits)
        by_kind = hits.groupBy("value", "pattern_kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("trust"))
        made = by_kind.groupBy("value").agg(F.max(F.struct("trust", "pattern_kind")).alias("b")).select("value", F.col("b.pattern_kind").alias("kind"), F.col("b.trust").alias("trust"))
        made = made.where(F.col("trust") >= MIN_CONFIDENCE)
        if new is not None:  # what is known stays known, so the rounds end
            made = new.unionByName(made.join(new.select(F.col("value").alias("n")), F.col("value") == F.col("n"), "left_anti"))
        new = cut(made)
        n = new.count()
        if n in (0, seen):
            break
        seen = n
    hit = others.join(new.select(F.col("value").alias("v"), "kind"), F.col("value") == F.col("v"))
    # the spans of one text
    return hit.groupBy("id", "h").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))


def _listed(spans: list[Column]) -> Column:
    """kind:start:end of the spans (from ``_bare``, by kind), in order, comma-joined."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    return F.array_join(F.concat(*[F.transform(F.array_sort(s), text) for s in spans]), ",")


def find(docs: DataFrame) -> DataFrame:
    """id, h, a column of spans for each fixed pattern, and ``more``: spans of the method (kind, start, end)."""
    base = cut(seeds(docs))
    more = discovered(base)
    more = more.select(F.col("id").alias("i"), F.col("h").alias("g"), "more")
    joined = base.join(more, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return joined.select("id", "h", *KINDS, F.coalesce("more", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("more"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the seeds; spans: seeds and found ones; n_found."""
    found = find(docs)
    base = [_bare(k, F.col(k)) for k in KINDS]
    every = [*(F.concat(own, _bare(k, F.col("more"), True)) for k, own in zip(KINDS, base, strict=True)), _bare("secret", F.col("more"), True)]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("id").cast("long").alias("doc_id"), *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("more").cast("long").alias("n_found"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets; overlapping spans become one."""
    found = find(docs)
    flat = F.concat(*[_bare(k, F.col(k)) for k in KINDS], *[_bare(k, F.col("more"), True) for k in ALL_KINDS])
    spans = found.select(F.col("id").alias("__p_id"), F.col("h").alias("__p_h"), F.array_sort(flat).alias("__p_spans")).where(F.size("__p_spans") > 0).dropDuplicates(["__p_id", "__p_h"])
    keyed = docs.withColumn("__p_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("__p_id")) & (F.col("__p_text") == F.col("__p_h")), "left")

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        before = F.substring("text", (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        fresh = F.array(before, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at")), F.when(x["start"] >= a["at"], fresh).otherwise(F.array().cast("array<string>"))

    pieces = _folded(F.col("__p_spans"), F.struct(F.lit(0).cast("long").alias("at")), F.array().cast("array<string>"), step)
    last = F.array_max(F.transform("__p_spans", lambda x: x["end"]))
    whole = F.concat(F.array_join(pieces, ""), F.substring("text", (last + 1).cast("int"), F.length("text")))
    text = F.when(F.col("__p_spans").isNull(), F.col("text")).otherwise(whole)
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
