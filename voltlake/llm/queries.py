"""Queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm.common import table
from voltlake.llm.op1_media import media_digest
from voltlake.llm.op2_lines import BASE, PRIME, dedupe_lines
from voltlake.llm.op3_licences import TRIGGER, scan_licences
from voltlake.llm.op4_mixing import mix
from voltlake.llm.op5_toxicity import toxicity
from voltlake.llm.op6_pii import pii_digest
from voltlake.llm.op7_jaccard import jaccard_join
from voltlake.llm.op8_suffix import suffix_dedup
from voltlake.llm.op9_decontam import contaminated
from voltlake.llm.op10_tokens import count_tokens
from voltlake.llm.op11_spelling import spelling_variants
from voltlake.llm.op12_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes
from voltlake.llm.op13_secrets import secret_digest


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedupe_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP2_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), hashed AS (
  SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM split
), ended AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR (i >= 3
    AND ((((h[i - 2] % {PRIME}) * {BASE} + h[i - 1]) % {PRIME}) * {BASE} + h[i]) % {PRIME} % 4 = 0)) AS ends FROM hashed
), chunks AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ends) + 1), lambda k: {{'no': k - 1, 'lines': list_slice(lines, CASE WHEN k = 1 THEN 1 ELSE ends[k - 1] + 1 END, ends[k])}})) AS c FROM ended
), flat AS (
  SELECT doc_id, c.no AS no, len(c.lines) AS n, array_to_string(c.lines, chr(10)) AS bytes FROM chunks
), ranked AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, bytes ORDER BY doc_id, no) > 1 AS gone FROM flat
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  count(*) FILTER (gone)::BIGINT AS n_removed_chunks, md5(coalesce(string_agg(bytes, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_md5
FROM ranked GROUP BY doc_id
"""


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; one that ends in a line of licence is its directory's licence file."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))))
    notice = F.substring_index(F.rtrim("text", F.lit(" \r\n\t")), "\n", -1).rlike(TRIGGER)
    found = scan_licences(docs, "path", notice)
    return found.select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "origin", "licence_path")


#: Shares of the mixed tokens by domain.
TARGETS = {"good": 0.9, "junk": 0.09, "toxic": 0.01}


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TARGETS)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("items").cast("long").alias("n_items"), (F.size("items") > 0).alias("contaminated"), F.transform("items", lambda x: x["item_id"]).alias("item_ids"), F.round(F.array_max(F.transform("items", lambda x: x["coverage"])), 4).alias("coverage"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


#: Words meet where they are equal without one letter; forms are followed one by one. CRC-32 by its table.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, run, times, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT *, encode(coalesce(doc_id::VARCHAR, '') || ':' || run) AS b FROM once)),
hashed AS (SELECT run, times, xor(4294967295, list_reduce([4294967295] || b, lambda c, x: xor(t[(xor(c, x) % 256) + 1], c >> 8))) AS h FROM bytes, crc),
formed AS (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM formed WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON b.rest = a.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM near),
best AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.k = 1),
chain AS (SELECT word, word AS root FROM best UNION ALL SELECT c.word, b.form FROM chain c JOIN best b ON b.word = c.root WHERE b.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN best b ON b.word = c.root WHERE b.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM best JOIN ends USING (word)
"""


def _codes_sql() -> str:
    """Codebooks round by round, all distances by plain integer sums."""
    steps = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""dist{k} AS (SELECT vec_id, label, part.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM part JOIN book{k} b ON b.p = part.p),
own{k} AS (SELECT * FROM dist{k} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) = 1)""")
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM own{k}, range(1, (SELECT max(len(x)) FROM part) + 1) AS r(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    last = f"own{ROUNDS}"
    return f"""WITH {', '.join(steps)},
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) FROM book{ROUNDS})) AS codebooks_sha256 FROM coded"""


OP12_SQL = _codes_sql()

#: Brute force: the n-gram sets of all distinct texts meet on each n-gram; classes grow by the links until they stay.
OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, string_split_regex(trim(lower(coalesce(text, '')), E' \n\t\r'), '\s+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')))) END AS grams FROM t),
sets AS (SELECT grams, len(grams) AS n, min(doc_id) AS rep, count(*) AS copies FROM g WHERE len(grams) > 0 GROUP BY grams),
one AS (SELECT rep, n, unnest(grams) AS gram FROM sets),
met AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c FROM one a JOIN one b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY ALL),
link AS (SELECT u, v FROM met JOIN sets x ON x.rep = u JOIN sets y ON y.rep = v WHERE c * 1.8 >= 0.8 * (x.n + y.n) - 1e-9),
reach AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON l.u = r.v),
class AS (SELECT rep, least(rep, coalesce(min(v), rep)) AS class_id FROM sets LEFT JOIN reach ON u = rep GROUP BY rep),
linked AS (SELECT u AS rep, count(*) AS texts, sum(copies) AS docs FROM link JOIN sets ON sets.rep = link.v GROUP BY u)
SELECT g.doc_id, coalesce(class.class_id, g.doc_id) AS class_id, coalesce(copies - 1 + coalesce(docs, 0), 0)::BIGINT AS n_links, coalesce(texts, 0)::BIGINT AS n_linked_texts
FROM g LEFT JOIN sets USING (grams) LEFT JOIN class USING (rep) LEFT JOIN linked USING (rep)
"""

#: Brute force: every string of 200 bytes of every document, by its hash.
OP8_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT id, doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT id, s, md5(hex(b[s + 1 : s + 200])) AS h FROM (SELECT id, b, unnest(range(n - 199)) AS s FROM n WHERE n >= 200)),
r AS (SELECT id, s, s + 200 AS e FROM (SELECT id, s, count(*) OVER (PARTITION BY h) AS k FROM w) WHERE k > 1),
f AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT id, s, e, sum(fresh) OVER (PARTITION BY id ORDER BY s) AS k FROM f),
x AS (SELECT id, k, min(s) AS a, max(e) AS z FROM g GROUP BY id, k),
c AS (SELECT id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM x GROUP BY id)
SELECT doc_id, n AS n_bytes, coalesce(list_sum(z) - list_sum(a), 0)::BIGINT AS n_removed, coalesce(len(a), 0)::BIGINT AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(len(a) + 1), lambda i: b[CASE WHEN i = 0 THEN 1 ELSE z[i] + 1 END : CASE WHEN i = len(a) THEN n ELSE a[i + 1] END]), lambda p, q: p || q) END) AS kept_sha256
FROM n LEFT JOIN c USING (id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_line_dedup": op2_line_dedup,
    "op3_licence_scan": op3_licence_scan,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op11_spelling_variants": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
}
