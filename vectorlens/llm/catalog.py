"""Registered queries of this subpackage, each over its whole table, with SQL where SQL can say the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorlens.llm import (
    brown,
    decontaminate,
    language,
    merkle,
    mixing,
    neighbour_lists,
    ngram_join,
    packing,
    personal,
    secrets,
    substrings,
    token_files,
    vector_codes,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents")).drop("finish")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)) AS weight
  FROM s
), r AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER ()
          - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM w
), l AS (SELECT arg_min(lvl, ratio) AS lvl FROM r WHERE lvl <= ratio),
t AS (SELECT source, source_size, least(cap, coalesce(weight * l.lvl, cap)) AS target FROM r, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(least(greatest(floor(target) - before, 0), size)
          + least(greatest(floor(target) - before - source_size, 0), size) AS BIGINT) AS taken
FROM p
"""


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_posting_lists(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_lists.nearest(table(spark, folder, "embeddings"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, folder, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM x),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM h) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM r, (SELECT unnest(range(0, 20)) AS o)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (
  SELECT p.doc_id, count(*) AS n_removed_not, string_agg(word, ' ' ORDER BY p.p) AS t
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p WHERE c.p IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(g.n_removed_not, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(g.t, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_components(table(spark, folder, "documents")).drop("text_key")


def op8_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, folder, "documents")).drop("text_key")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_report(table(spark, folder, "documents"))


def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal.personal_report(table(spark, folder, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh
  FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
e AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM s
  UNION
  SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.v) AS component_id
FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.sh
"""

OP8_LINKS_SQL = OP8_SQL.replace(
    """SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.v) AS component_id
FROM s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.sh
""",
    """, c AS (
  SELECT e.u, count(DISTINCT list_sort(b.sh)) AS n_links
  FROM e JOIN s a ON a.doc_id = e.u JOIN s b ON b.doc_id = e.v WHERE list_sort(a.sh) <> list_sort(b.sh) GROUP BY e.u
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CAST(coalesce(any_value(c.n_links), 0) AS BIGINT) AS n_links,
       min(r.v) AS component_id
FROM s JOIN reach r ON r.u = s.doc_id LEFT JOIN c ON c.u = s.doc_id GROUP BY s.doc_id, s.sh
""",
)


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_digest(table(spark, folder, "documents"), token_files.vocabulary("word_bpe_49k.json"))


def op10_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.shard_report(table(spark, folder, "documents"), 8)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_report(table(spark, folder, "embeddings"))


def _codebook_round(r: int) -> str:
    """Nearest entries under codebook ``c{r}``, and the codebook ``c{r + 1}`` of their floored means."""
    return f"""
    a{r} AS MATERIALIZED (
      SELECT k, part, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
        SELECT p.k, p.part, c.e, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM p JOIN c{r} c ON c.part = p.part
      ) GROUP BY k, part
    ), s{r} AS (
      SELECT part, e, pos, sum(x)::BIGINT AS s, count(*) AS n
      FROM (SELECT p.part, a.e, unnest(p.x) AS x, generate_subscripts(p.x, 1) AS pos FROM p JOIN a{r} a ON a.k = p.k AND a.part = p.part)
      GROUP BY part, e, pos
    ), m{r} AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{r} GROUP BY part, e),
    c{r + 1} AS MATERIALIZED (
      SELECT c.part, c.e, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.e = c.e
    )"""


OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, len(embedding) // 4 AS w,
         list_transform(embedding, lambda x: CAST(floor(1024::DOUBLE * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT k, vec_id, label, part, v[(part * w + 1):(part * w + w)] AS x FROM v, (SELECT unnest(range(4)) AS part)
), c0 AS MATERIALIZED (SELECT part, k - 1 AS e, x AS c FROM p WHERE k <= 256),
{",".join(_codebook_round(r) for r in range(5))},
h AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, pos)) AS codebooks_sha256
  FROM (SELECT part, e, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM c4)
), f AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY k)
SELECT v.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM f JOIN v USING (k) CROSS JOIN h
"""


def op12_merkle_log(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tamper_report(table(spark, folder, "documents"))


def _leaf_sql(n_chars: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(concat(" + ", ".join(f"coalesce(concat(strlen({c}), ':', {c}), '-')" for c in fields) + "))"


# The checksum goes bit by bit over the digits of the id, as the public CRC-32 polynomial is applied.
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('+' || lang, '') AS tree, {_leaf_sql("n_chars")} AS leaf,
         {_leaf_sql("(n_chars + 1)")} AS changed,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           range(1, len(CAST(doc_id AS VARCHAR)) + 1),
           lambda i: [ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS crc
  FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d
), nodes AS (
  SELECT tree, 0 AS h, i, leaf AS d, n FROM o
  UNION ALL
  SELECT tree, h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, h, i // 2, n
), subs AS (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS h, i, subroot AS d, n FROM subs
  UNION ALL
  SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY h, i // 2, n
), steps AS (
  SELECT o.k, l.h AS step, CAST((o.i >> l.h) & 1 AS INTEGER) AS odd, s.d
  FROM o JOIN (SELECT DISTINCT tree, h FROM nodes WHERE n > 1) l ON l.tree = o.tree
  LEFT JOIN nodes s ON s.tree = o.tree AND s.h = l.h AND s.i = xor(o.i >> l.h, 1)
  UNION ALL
  SELECT o.k, 1000 + l.h, CAST((u.i >> l.h) & 1 AS INTEGER), s.d
  FROM o JOIN subs u ON u.tree = o.tree CROSS JOIN (SELECT DISTINCT h FROM tops WHERE n > 1) l
  LEFT JOIN tops s ON s.h = l.h AND s.i = xor(u.i >> l.h, 1)
), path AS (
  SELECT k, list(struct_pack(odd := odd, d := d) ORDER BY step) AS p, sha256(coalesce(string_agg(d, '' ORDER BY step), '')) AS proof
  FROM steps GROUP BY k
), fold AS (
  SELECT o.k, 1 AS pos, CASE WHEN crc % 7 = 0 THEN coalesce(changed, leaf) ELSE leaf END AS cur, p FROM o LEFT JOIN path USING (k)
  UNION ALL
  SELECT k, pos + 1,
         sha256(CASE WHEN p[pos].d IS NULL THEN cur WHEN p[pos].odd = 1 THEN p[pos].d || cur ELSE cur || p[pos].d END), p
  FROM fold WHERE pos <= len(p)
), root AS (SELECT d AS root FROM tops WHERE n = 1)
SELECT o.doc_id, o.leaf, u.subroot, r.root, coalesce(path.proof, sha256('')) AS proof_sha256, f.cur AS folded_root, f.cur = r.root AS verified
FROM o JOIN subs u ON u.tree = o.tree CROSS JOIN root r LEFT JOIN path ON path.k = o.k
JOIN (SELECT k, arg_max(cur, pos) AS cur FROM fold GROUP BY k) f ON f.k = o.k
"""


def op13_brown_scores(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score_report(table(spark, folder, "documents"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_mix": (op1_mix, OP1_SQL),
    "op2_secrets": (op2_secrets, None),
    "op3_decontamination": (op3_decontamination, None),
    "op4_posting_lists": (op4_posting_lists, None),
    "op5_substring_dedup": (op5_substring_dedup, OP5_SQL),
    "op6_language": (op6_language, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_ngram_join": (op8_ngram_join, OP8_SQL),
    "op8_link_counts": (op8_link_counts, OP8_LINKS_SQL),
    "op9_token_files": (op9_token_files, None),
    "op10_bin_packing": (op10_bin_packing, None),
    "op11_vector_codes": (op11_vector_codes, OP11_SQL),
    "op12_merkle_log": (op12_merkle_log, OP12_SQL),
    "op13_brown_scores": (op13_brown_scores, None),
}
