"""The thin query of each corpus operator over the ``documents`` table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.llm import byte_bpe, ctph, exact_dedup, license_scan, packing, quality, secret_scan, sharding, simhash, token_output
from callgauge.llm.common import table, text_of


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: 40 shards whose numbers of rows differ by one at most."""
    out = sharding.write_shards(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode(text_of("text"), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["ord"] < len(secret_scan.BASE))
    counts = [F.size(F.filter("spans", _of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_output.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_output.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), width=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_next(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    how = tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), *how), *how)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    starts = F.transform("places", lambda x: x["start"])
    best = F.array_max(F.transform("matches", lambda x: x["share"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("places").alias("base_labels"), labels("matches").alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

def _either(word: str) -> str:
    """ASCII letters of either case, spelled out: the engine's own folding goes beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]{16,}"), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("github", "gh[pousr]_[A-Za-z0-9]{36,}"))

#: Matches are marked in place; running sums of the lengths between the marks are positions.
OP3_SQL = (
    "WITH t AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS x FROM documents), k AS ("
    + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{kind}' AS kind, string_split(regexp_replace(x, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM t" for i, (kind, pattern) in enumerate(_KINDS))
    + f"""), s AS (SELECT doc_id, ord, kind, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM k),
p AS (SELECT doc_id, ord, kind, i, split_part(part, chr(2), 1) AS m, length(part) - CASE WHEN i > 0 THEN 1 ELSE 0 END AS n FROM s),
e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, ord ORDER BY i) - n + length(m) AS stop FROM p),
f AS (SELECT doc_id, ord, kind, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e
      WHERE i > 0 AND CASE kind WHEN 'assign' THEN length(regexp_extract(m, '{_ASSIGN}', 2)) >= 12 WHEN 'access' THEN length(m) >= 18 ELSE true END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)
"""
)

QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash, op3_secret_scan, op4_token_output, op5_packing, op6_fingerprints, op7_exact_dedup, op8_quality, op9_byte_bpe, op10_license_scan)}
SQL = {"op3_secret_scan": OP3_SQL, "op7_exact_dedup": OP7_SQL}
