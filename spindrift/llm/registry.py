"""Queries ``opN_<name>`` of this subpackage, their production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, jaccard_join, line_dedup, packing, pii, piece_encoding, quality, sharding, spelling, suffix_dedup, token_counts, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), length=5, threshold=75).drop("uid")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), run=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40, ["lang"])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(F.col(c) + 1e-8, 6) for c in ("class_distance", "word_distance")})


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), passage=50)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("uid")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), least_letters=7, least_count=2, factor=10)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_piece_encoding": op12_piece_encoding,
    "op13_hard_negatives": op13_hard_negatives,
}

_WORDS = "list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda x: x <> '')"

#: The others learn, balance, scan or tokenise: tests hold them against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM w),
x AS (SELECT doc_id, len(s) n, unnest(s) g FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) n_shingles, m.b component_id FROM s JOIN (SELECT a, min(b) b FROM r GROUP BY a) m ON m.a = s.doc_id""",
    "op3_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) p FROM l WHERE regexp_matches(line, '[^ \t-\r]')),
g AS (SELECT doc_id, p, no, lead(no) OVER w no2, line, lead(line) OVER w line2 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
e AS (SELECT *, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, p) k FROM g WHERE line2 IS NOT NULL),
d AS (SELECT doc_id, no FROM e WHERE k > 1 UNION SELECT doc_id, no2 FROM e WHERE k > 1),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (d.no IS NULL) t, count(*) n, count(d.no) r FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.no = l.no GROUP BY l.doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text, coalesce(k.n, 0) n_lines, coalesce(k.r, 0) n_removed FROM documents o LEFT JOIN k USING (doc_id)""",
    "op5_quality": rf"""
WITH d AS (SELECT row_number() OVER () uid, doc_id, lang, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') w FROM d),
b AS (SELECT *, len(w) n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, length(t) chars, length(t) - length(regexp_replace(t, '[a-z]+', '', 'g')) lower_, length(regexp_replace(t, '[^A-Z]+', '', 'g')) upper_, length(regexp_replace(t, '[^0-9]+', '', 'g')) digits, length(regexp_replace(t, '[\x00-\x7f]+', '', 'g')) beyond, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) ls FROM w),
c AS (SELECT *, chars - word_chars blank, word_chars - n_symbols - lower_ - upper_ - digits - beyond rest FROM b),
g AS (SELECT uid, i, array_to_string(w[i:i + 4], ' ') k FROM (SELECT uid, w, unnest(range(1, len(w) - 3)) i FROM w)),
r AS (SELECT uid, i FROM g QUALIFY count(*) OVER (PARTITION BY uid, k) > 1),
rw AS (SELECT uid, sum(least(5, coalesce(nx - i, 5))) n FROM (SELECT uid, i, lead(i) OVER (PARTITION BY uid ORDER BY i) nx FROM r) GROUP BY uid),
lc AS (SELECT lang, greatest(sum(chars), 1) z, sum(lower_) a, sum(upper_) b, sum(digits) c, sum(n_symbols) d, sum(beyond) e, sum(blank) f, sum(rest) g FROM c GROUP BY lang),
lw AS (SELECT lang, word, count(*) n FROM (SELECT lang, unnest(regexp_split_to_array(lower(t), '[ \t-\r]+')) word FROM d) WHERE word <> '' GROUP BY lang, word),
ls AS (SELECT lang, word, share FROM (SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) share FROM lw) WHERE share >= {quality.SHARE} QUALIFY row_number() OVER (PARTITION BY lang ORDER BY share DESC, word) <= {quality.WORDS}),
dw AS (SELECT uid, unnest(list_transform(w, lambda x: lower(x))) word FROM w),
dn AS (SELECT uid, word, count(*) n FROM dw GROUP BY uid, word),
hw AS (SELECT c.uid, ls.word, ls.share q, coalesce(dn.n, 0) / greatest(c.n_words, 1) p FROM c JOIN ls ON ls.lang IS NOT DISTINCT FROM c.lang LEFT JOIN dn ON dn.uid = c.uid AND dn.word = ls.word),
ho AS (SELECT uid, q, p FROM hw UNION ALL SELECT uid, greatest(1 - sum(q), 0), CASE WHEN min(n_words) = 0 THEN 0 ELSE greatest(1 - sum(p), 0) END FROM hw JOIN c USING (uid) GROUP BY uid),
hc AS (SELECT uid, unnest([lower_, upper_, digits, n_symbols, beyond, blank, rest]) / greatest(chars, 1) p, unnest([lc.a / z, lc.b / z, lc.c / z, lc.d / z, lc.e / z, lc.f / z, lc.g / z]) q FROM c JOIN lc ON lc.lang IS NOT DISTINCT FROM c.lang),
jc AS (SELECT uid, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) d FROM hc GROUP BY uid),
jw AS (SELECT uid, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) d FROM ho GROUP BY uid),
f AS (SELECT c.*, coalesce(rw.n, 0) n_repeat_words, CASE WHEN chars >= {quality.MIN_CHARS} THEN jc.d END cd, CASE WHEN n_words >= {quality.MIN_WORDS} THEN jw.d END wd FROM c LEFT JOIN rw USING (uid) LEFT JOIN jc USING (uid) LEFT JOIN jw USING (uid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= {quality.MAX_CLASS} AND coalesce(wd, 0) <= CASE WHEN n_words >= {quality.LONG} THEN {quality.MAX_WORD} ELSE {quality.MAX_WORD_SHORT} END AS kept, round(cd + 1e-8::DOUBLE, 6) class_distance, round(wd + 1e-8::DOUBLE, 6) word_distance FROM v""",
    "op6_suffix_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i + 1:i + 50], ' ')) h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) i FROM w)),
s AS (SELECT h, min(doc_id) lo, max(doc_id) hi FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, i, CASE WHEN doc_id = lo THEN hi ELSE lo END other FROM g JOIN s USING (h)),
o AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END o FROM m),
r AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY i) r FROM o)
SELECT doc_id, min(i) start_word, max(i) + 50 end_word, max(i) + 50 - min(i) n_words, min_by(other, i) other_doc_id FROM r GROUP BY doc_id, r""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, b.vec_id other, a.label = b.label same, CAST(list_dot_product(a.q, b.q) AS BIGINT) score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other positive_id, score positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other negative_id, positive_score, score negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10""",
}
