"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, html_text, itemsets, lexical, near, packing, pii, quality, spans, toxicity, vectors
from .tools import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(table(spark, sf_dir, "documents"), 85).drop("row")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.without_repeats(docs, spans.SENTENCES, "n_sentences", "n_removed")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words wherever they begin and end, which runs of three sentences (and their SQL) don't all find."""
    return spans.without_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_words", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.without_repeats(docs, spans.LINES, "n_lines", "n_removed")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, 4096, 2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("row")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.itemset_report(table(spark, sf_dir, "sale_lines"), "sale_id", "item_id")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_pii, op2_toxicity, op3_bpe, op4_html, op5_near_dedup, op6_substring_dedup, op6_passage_dedup, op7_line_dedup, op8_packing, op9_quality, op10_fingerprints, op11_itemsets, op12_neighbours, op13_ranked_search)
    return {f.__name__: f for f in made}


_REPEATS = """
WITH d AS (SELECT doc_id, text, {units} AS u FROM documents),
t AS (SELECT doc_id, text, u, list_transform(u, lambda x: trim(x, E' \\t\\n\\r\\f\\v')) AS b FROM d),
n AS (SELECT doc_id, text, u, b, list_filter(range(1, len(u) + 1), lambda i: b[i] <> '') AS pos FROM t),
w AS (SELECT doc_id, b, pos, unnest(range(1, len(pos) - 1)) AS j FROM n WHERE len(pos) >= 3),
k AS (SELECT doc_id, pos, j, b[pos[j]] AS x, b[pos[j + 1]] AS y, b[pos[j + 2]] AS z,
  list_sum(list_transform([b[pos[j]], b[pos[j + 1]], b[pos[j + 2]]], lambda s: len(string_split_regex(s, '[ \\t\\n\\r\\f\\v]+')))) AS words FROM w),
f AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, j) AS r FROM k WHERE words >= {least}),
g AS (SELECT doc_id, list(DISTINCT pos[j + s]) AS gone FROM (SELECT doc_id, pos, j, unnest([0, 1, 2]) AS s FROM f WHERE r > 1) GROUP BY doc_id)
SELECT n.doc_id, coalesce(len(pos), 0)::BIGINT AS {total}, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_filter(u, lambda x, i: NOT list_contains(gone, i)), {joiner}), '') END AS text
FROM n LEFT JOIN g ON n.doc_id = g.doc_id
"""


_ITEMSETS = """
WITH RECURSIVE b AS (SELECT DISTINCT sale_id AS s, item_id AS i FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT s)::BIGINT AS total FROM b),
one AS (SELECT i, count(*)::BIGINT AS support FROM b GROUP BY i HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT total FROM n)),
f AS (SELECT s, i FROM b JOIN one USING (i)),
r AS (SELECT [i] AS items, i AS last, list(s) AS held FROM f GROUP BY i UNION ALL
  SELECT list_append(o.items, f.i), f.i, list(f.s) FROM (SELECT items, last, unnest(held) AS s FROM r) o JOIN f ON f.s = o.s AND f.i > o.last
  GROUP BY o.items, f.i HAVING count(*) >= 5 AND count(*) * 20000 >= (SELECT total FROM n)),
x AS (SELECT items, len(items) AS k, len(held)::BIGINT AS support FROM r),
part AS (SELECT items, support, unnest(items) AS c FROM x WHERE k > 1),
rest AS (SELECT items, support, c, list_filter(items, lambda y: y <> c) AS rest FROM part),
above AS (SELECT rest AS items, max(support) AS support FROM rest GROUP BY rest),
closed AS (SELECT x.items, x.k, x.support FROM x LEFT JOIN above USING (items) WHERE above.support IS NULL OR above.support < x.support),
rule AS (SELECT t.items, t.c, x.support AS a, one.support AS s FROM rest t JOIN closed c ON c.items = t.items JOIN x ON x.items = t.rest JOIN one ON one.i = t.c, n
  WHERE 100 * t.support >= 60 * x.support AND t.support * total > x.support * one.support),
found AS (SELECT items, count(*)::BIGINT AS n_rules, first(c ORDER BY a, c) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS told FROM rule GROUP BY items)
SELECT array_to_string(items, ',') AS items, k::BIGINT AS n_items, support, coalesce(n_rules, 0)::BIGINT AS n_rules, best_item, sha256(coalesce(told, '')) AS rules_sha256
FROM closed LEFT JOIN found USING (items)
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT count(*)::BIGINT AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
o AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM o WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, size GROUP BY term),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM f JOIN w USING (term) JOIN i USING (term), size GROUP BY item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s
WHERE score > 0 AND doc_id IS NOT NULL AND item_id IS NOT NULL QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    sentences = r"string_split(regexp_replace(text, '([.!?,;:][ \t\r\n]|\n)', '\1' || chr(1), 'g'), chr(1))"
    return {
        "op6_substring_dedup": _REPEATS.format(units=sentences, joiner="''", total="n_sentences", least=spans.SENTENCES.least_words),
        "op7_line_dedup": _REPEATS.format(units="string_split(text, chr(10))", joiner="chr(10)", total="n_lines", least=1),
        "op11_itemsets": _ITEMSETS,
        "op13_ranked_search": _RANKED,
    }
