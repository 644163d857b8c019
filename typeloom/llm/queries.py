"""The registered queries of this subpackage and the SQL that some of them can be checked by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm import decontaminate, language_id, license_scan, line_dedup, packing, quality, sharding, simhash, token_counts, wavelet
from typeloom.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("line_dedup_n_lines").alias("n_lines"), F.col("line_dedup_n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def packing_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op2 that SQL can tell."""
    return op2_packing(spark, sf_dir).select("doc_id", "n_tokens")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can tell."""
    return op6_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict:
    own = (
        op1_license_scan, op2_packing, op3_token_counts, op4_wavelet_output, op5_decontamination, op6_quality_rules,
        op7_line_dedup, op8_simhash, op9_language_id, op10_sharding, pipeline, packing_lengths, quality_base,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": op1_sql(), "op5_decontamination": op5_sql(), "op7_line_dedup": OP7, "op10_sharding": OP10,
        "packing_lengths": PACKING_LENGTHS, "quality_base": QUALITY_BASE,
    }


#: The pattern of common.BREAKS in the syntax of RE2.
BREAKS = r"[\x00-/:-`{-\x7f\x{a0}-\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]+"
WORD = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{BREAKS}'), lambda x: x <> '')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def op1_sql() -> str:
    """Exact containment of every template in every document: no windows, no MinHash."""
    size, templates = license_scan.SHINGLE, license_scan.TEMPLATES
    shingles = [sorted(set(license_scan.template_shingles(text))) for _, text in templates]
    rows = ", ".join(f"({k}, {_quoted(name)}, [{', '.join(map(_quoted, ss))}])" for k, ((name, _), ss) in enumerate(zip(templates, shingles, strict=True)))
    rivals = ", ".join(f"({k}, {j})" for k, own in enumerate(license_scan.rivals_of(shingles, 0.8)) for j in own)
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(size))
    return f"""WITH t(no, license, s) AS (VALUES {rows}), rivals(no, other) AS (VALUES {rivals}),
d AS (SELECT doc_id, row_number() OVER () AS r, {_words('text')} AS w FROM documents),
g AS (SELECT doc_id, r, list_transform(range(1, len(w) - {size - 2}), lambda i: {joined}) AS g FROM d WHERE len(w) >= {size}),
m AS (SELECT doc_id, r, no, license, len(list_intersect(s, g)) / len(s)::DOUBLE AS containment FROM g, t),
k AS (SELECT * FROM m WHERE containment >= 0.8)
SELECT doc_id, license, no AS template_no, containment, EXISTS (SELECT 1 FROM rivals v JOIN k o ON o.no = v.other WHERE v.no = k.no AND o.r = k.r AND o.containment > k.containment) AS outdone FROM k"""


def op5_sql() -> str:
    """Seeds joined as the words that they count, hits verified over whole items and documents."""
    span, parts = decontaminate.SPAN, []
    for k, seed in enumerate(decontaminate.SEEDS):
        key = " || ' ' || ".join(f"w[i + {j}]" for j, c in enumerate(seed) if c == "1")
        parts.append(f"SELECT {{id}}, {k} AS seed, {len(seed)} AS span, i, {key} AS key, w FROM (SELECT *, unnest(range(1, len(w) - {len(seed) - 2})) AS i FROM {{of}} WHERE len(w) >= {len(seed)})")
    every = " UNION ALL ".join(parts)
    return f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
ds AS ({every.format(id='doc_id', of='d')}), bs AS ({every.format(id='item_id', of='b')}),
h AS (SELECT ds.doc_id, bs.item_id, ds.w AS near, bs.w AS item, ds.i - bs.i AS shift, bs.i AS place, bs.span AS span, least({span}, len(bs.w)) AS width FROM ds JOIN bs ON ds.seed = bs.seed AND ds.key = bs.key),
r AS (SELECT *, greatest(place + span - width, 1, 1 - shift) AS low, least(place + width - 1, len(item), len(near) - shift) - width + 1 AS high FROM h),
a AS (SELECT doc_id, item_id, list_max(list_transform(range(low, high + 1), lambda s: len(list_filter(range(s, s + width), lambda q: item[q] = near[q + shift])) / width::DOUBLE)) AS agreement FROM r WHERE high >= low)
SELECT doc_id, item_id, max(agreement) AS agreement, count(*) AS n_hits FROM a WHERE agreement >= 0.8 GROUP BY doc_id, item_id"""


#: crc32 is worked out byte by byte; first bytes by a running sum over all rows.
OP10 = """WITH RECURSIVE c(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, len(h) // 2 + 1 AS size, list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda p: (strpos('0123456789ABCDEF', p[1]) - 1) * 16 + strpos('0123456789ABCDEF', p[2]) - 1)) AS bytes FROM x),
z AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM y, tab),
f AS (SELECT *, sum(size) OVER w - size AS first_byte, sum(size) OVER () AS total, row_number() OVER w AS row FROM z WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(15, (16 * (2 * first_byte + size)) // (2 * total))::INT AS shard FROM f)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY row) - 1 AS slot, NULL::INT AS grown_shard, first_byte::BIGINT AS first_byte FROM s"""

PACKING_LENGTHS = f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1 AS n_tokens FROM documents"

QUALITY_BASE = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT r, j, array_to_string(w[j:j + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS j FROM d WHERE len(w) >= 8)),
v AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(j, j + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM d JOIN l USING (r) LEFT JOIN v USING (r)"""

#: A row is a document of its own, whatever its doc_id.
OP7 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, r, u.i AS i, u.line AS line, translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, r, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z FROM d) x, LATERAL (SELECT z[1] AS i, z[2] AS line) u),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM f)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k NOT IN (SELECT k FROM f)), '')) AS kept_sha256
FROM l GROUP BY doc_id, r
"""
