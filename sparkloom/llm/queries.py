"""Registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_private")


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .classifier import classify

    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(documents(spark, sf_dir))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op8_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(documents(spark, sf_dir))


def op9_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir), digest=True)


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score

    return score(documents(spark, sf_dir))


def op11_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mine

    return mine(documents(spark, sf_dir))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_cube_mix, op2_anchor_pii, op3_weak_supervision, op4_byte_cnn, op5_signatures, op6_minhash, op7_best_fit, op8_differencing, op9_refinement, op10_kneser_ney, op11_phrase_growth, op12_line_runs)}


#: Texts without white space; DuckDB regular expressions run on code points.
OP9 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
h AS (SELECT doc_id, length(x) AS n, sha256(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
      count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

#: All links between sets of distinct 2-word shingles, by their shared shingles; then components.
OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) = 1 THEN [a[1]] ELSE list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c FROM sn x JOIN sn y ON x.g = y.g AND x.doc_id <> y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80 GROUP BY 1, 2, 3, 4),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a),
k AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN k USING (doc_id)
"""

#: All phrases of up to three words by self-joins of their counts; lists of words are the keys.
OP11 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, m, w[i:i + m - 1] AS g, count(*) AS f FROM o, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE f >= 10),
x AS (SELECT lang, g, f AS a, unnest(range(1, m)) AS k, m FROM c WHERE m > 1),
s AS (SELECT x.lang, x.g, x.a, x.m, x.k, u.f AS l, v.f AS r, (1000000::HUGEINT * x.a * x.a) // (u.f::HUGEINT * v.f) AS score
      FROM x JOIN c u ON u.lang = x.lang AND u.g = x.g[1:x.k] JOIN c v ON v.lang = x.lang AND v.g = x.g[x.k + 1:x.m]),
b AS (SELECT lang, g, a, m, arg_min({'l': l, 'r': r, 'score': score}, {'score': score, 'k': k}) AS z FROM s GROUP BY ALL),
q AS (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM c WHERE m = 3),
d AS (SELECT lang, g, max(f) AS f FROM q GROUP BY ALL),
e AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.z.l AS l, b.z.r AS r, b.z.score AS score FROM b LEFT JOIN d ON d.lang = b.lang AND d.g = b.g WHERE d.f IS NULL OR 100 * d.f < 50 * b.a),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, n.n::BIGINT AS n, k.score::BIGINT AS score FROM k JOIN n USING (lang) WHERE k.rank <= 2000
"""

#: Lines of keys that ten documents share, left out.
OP12 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
i AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM d),
l AS (SELECT doc_id, i, a[i] AS line, translate(trim(a[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM i),
f AS (SELECT k, true AS gone FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.gone IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash": OP6, "op9_refinement": OP9, "op11_phrase_growth": OP11, "op12_line_runs": OP12}
