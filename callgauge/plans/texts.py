"""Queries of the text and retrieval families, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgauge.functions import text as fn
from callgauge.operators import retrieval
from callgauge.plans.tables import table
from callgauge.sources.files import kept

SYNONYMS = {"the": ["article", "definite article"], "and": ["conjunction"], "that": ["which"], "is": ["be", "to be"]}
RULES = [("the", "/en/", 0.25), ("and", "/fr/", 0.5), ("that", ".html", 0.125), ("for", "/en/1", 0.75), ("is", "/", 0.0625)]
K = 5


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", fn.tokens(F.col("text")).alias("_t"))
    return t.select("doc_id", F.size("_t").cast("long").alias("n"), F.array_join("_t", " ").alias("tokens"))


def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).select("doc_id", fn.tokens(F.col("text")).alias("_t"))
    return t.select("doc_id", F.array_join(F.transform("_t", fn.stem), " ").alias("tokens"))


def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items(spark, sf_dir).select("item_id", fn.tokens(F.col("text")).alias("_t")).select("item_id", fn.expand(F.col("_t"), SYNONYMS).alias("_x"))
    return t.select("item_id", F.explode("_x").alias("token")).groupBy("item_id", "token").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_frequencies(docs(spark, sf_dir), "doc_id", F.col("text"))


def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequencies(term_frequency(spark, sf_dir))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.idf(doc_frequency(spark, sf_dir), docs(spark, sf_dir).count()).select("term", "df", F.round("idf", 6).alias("idf"))


def best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.cfidf_topk(docs(spark, sf_dir), items(spark, sf_dir), "doc_id", "item_id", F.col("text"), F.col("text"), k, F.col("source"))


def cfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, K)


def trigram_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.containment_topk(docs(spark, sf_dir), items(spark, sf_dir), "doc_id", "item_id", F.col("text"), F.col("text"), K)


def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "token string, part string, bonus double")
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return retrieval.keyword_boost(items(spark, sf_dir), table(spark, sf_dir, "pages"), rules, "item_id", "page_id", F.col("text"), path)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = kept(best(spark, sf_dir, max(K, retrieval.CANDIDATES)).drop("rank"), "candidates")
    again = retrieval.containment(docs(spark, sf_dir), items(spark, sf_dir), "doc_id", "item_id", F.col("text"), F.col("text"), wide.select("item_id", "doc_id"))
    return wide.join(again, ["item_id", "doc_id"], "left").withColumn("containment", F.coalesce("containment", F.lit(0.0)))


def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top(candidates(spark, sf_dir), "item_id", K, F.col("containment").desc(), F.col("score").desc(), F.col("doc_id"))


def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", F.when(F.col("source").contains("1"), 0.25).otherwise(0.0).alias("boost")), "doc_id")
    total = retrieval.hybrid(c, {"score": 1.0, "containment": 2.0, "semantic": 0.0, "boost": 1.0})
    return retrieval.top(c.select("item_id", "doc_id", total.alias("hybrid")), "item_id", K, F.col("hybrid").desc(), F.col("doc_id"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 neighbours of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(vectors.filter("vec_id % 100 = 0"), vectors, 25)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, sf_dir)


def dedup_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = nearest(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return retrieval.dedup_ranked(labelled, "query_id", "label", "vec_id", K)


def hit_rate_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = nearest(spark, sf_dir).filter("rank <= 5 AND vec_id <> query_id").join(labels, "vec_id")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return retrieval.hit_rates(near.join(own, "query_id").groupBy("query_id", "own").agg(F.max((F.col("label") == F.col("own")).cast("int")).alias("hit")), "own")


def line_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fn.truncate_lines(F.col("text"), 800).alias("by_line"), fn.truncate_chars(F.col("text"), 500).alias("by_chars"))


def inline_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", fn.inline_comment(F.col("text")).alias("comment"), fn.first_sentence(F.col("text")).alias("sentence"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " "), " "), lambda w: w != "")
    w = docs(spark, sf_dir).select("doc_id", words.alias("_w"), F.array(F.col("lang"), F.col("source")).alias("_o")).select("doc_id", F.array_distinct("_w").alias("_d"), "_o")
    return w.select("doc_id", F.array_join("_d", " ").alias("in_order"), F.size(F.array_union("_d", "_o")).cast("long").alias("n_union"), F.array_join(F.array_sort(F.array_distinct("_o")), ",").alias("sorted"))


def pass_fail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = docs(spark, sf_dir).select("doc_id", F.col("text").rlike(r"[#$%&*]{3}|!!|\|").alias("matched")).join(table(spark, sf_dir, "labels"), "doc_id")
    return judged.select(F.when(F.col("quality") == 0, "positive").otherwise("negative").alias("expectation"), "matched").groupBy("expectation").agg(F.count_if("matched").alias("matching"), F.count_if(~F.col("matched")).alias("not_matching"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = "list_filter(string_split(regexp_replace(" + LOWER + ", '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')"
_T, _S = TOKENS.format("text"), TOKENS.format("source")
TF = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_T}) AS term FROM documents) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, df, ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / (df + 1)) AS idf FROM df)"""
SCORES = TF + f""",
ip AS (SELECT DISTINCT doc_id, unnest({_S}) AS term FROM documents),
dw AS (SELECT tf.doc_id, tf.term, tf * idf * CASE WHEN ip.term IS NOT NULL THEN 1.5 ELSE 1.0 END AS w FROM tf JOIN idf USING (term) LEFT JOIN ip ON tf.doc_id = ip.doc_id AND tf.term = ip.term),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY 1, 2),
qw AS (SELECT item_id, term, tf * coalesce(idf, ln((SELECT count(*) FROM documents))) AS w FROM qt LEFT JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dw GROUP BY 1), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
s AS (SELECT item_id, doc_id, round(dot / (dn.n * qn.n), 6) AS score FROM (SELECT item_id, doc_id, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (term) GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN qn USING (item_id) WHERE dn.n > 0 AND qn.n > 0)"""
_PLAIN = r"trim(regexp_replace(regexp_replace(" + LOWER.format("text") + r", '[^a-z0-9\x09-\x0D\x20]', '', 'g'), '[\x09-\x0D\x20]+', ' ', 'g'))"
GRAMS = f"""dg AS (SELECT DISTINCT doc_id, substr(p, i, 3) AS g FROM (SELECT doc_id, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT doc_id, {_PLAIN} AS p FROM documents))),
qg AS (SELECT DISTINCT item_id, substr(p, i, 3) AS g FROM (SELECT item_id, p, unnest(range(1, length(p) - 1)) AS i FROM (SELECT item_id, {_PLAIN} AS p FROM benchmark))),
qc AS (SELECT item_id, count(*) AS n FROM qg GROUP BY 1),
c AS (SELECT item_id, doc_id, round(count(*) / any_value(n), 6) AS containment FROM dg JOIN qg USING (g) JOIN qc USING (item_id) GROUP BY 1, 2)"""


def _top(source: str, columns: str, by: str, order: str, k: int) -> str:
    return f"SELECT {columns}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {k}"


CANDIDATES = f"{SCORES}, {GRAMS}, w AS ({_top('s', 'item_id, doc_id, score', 'item_id', 'score DESC, doc_id', 30)}), cand AS (SELECT w.item_id, w.doc_id, score, coalesce(containment, 0.0) AS containment FROM w LEFT JOIN c ON w.item_id = c.item_id AND w.doc_id = c.doc_id)"
NEAR = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
nd AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.e[i] - v.embedding[i]::DOUBLE) * (q.e[i] - v.embedding[i]::DOUBLE)))), 6) AS distance FROM q, embeddings v),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM nd QUALIFY rank <= 25)"""
_CASES = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(s) for s in v)}]" for k, v in SYNONYMS.items())
_RULES = ", ".join(f"('{t}', '{p}', CAST({b} AS DOUBLE))" for t, p, b in RULES)
_STEM = "CASE WHEN length(t) <= 3 THEN t WHEN ends_with(t, 'ing') AND length(t) > 5 THEN substr(t, 1, length(t) - 3) WHEN ends_with(t, 'ed') AND length(t) > 4 THEN substr(t, 1, length(t) - 2) WHEN ends_with(t, 's') THEN substr(t, 1, length(t) - 1) ELSE t END"

SQL = {
    "tokens": f"SELECT doc_id, len(t) AS n, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_T} AS t FROM documents)",
    "stemmed_tokens": f"SELECT doc_id, array_to_string(list_transform({_T}, lambda t: {_STEM}), ' ') AS tokens FROM documents",
    "synonym_expand": f"WITH t AS (SELECT item_id, unnest({_T}) AS token FROM benchmark), s AS (SELECT item_id, token FROM t UNION ALL SELECT item_id, unnest(CASE token {_CASES} END) FROM t) SELECT item_id, token, count(*) AS n FROM s GROUP BY 1, 2",
    "term_frequency": f"WITH {TF} SELECT * FROM tf",
    "doc_frequency": f"WITH {TF} SELECT * FROM df",
    "idf": f"WITH {TF} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "cfidf_topk": f"WITH {SCORES} " + _top("s", "item_id, doc_id, score", "item_id", "score DESC, doc_id", K),
    "trigram_containment": f"WITH {GRAMS} " + _top("c", "item_id, doc_id, containment", "item_id", "containment DESC, doc_id", K),
    "keyword_boost": f"""WITH r(token, part, bonus) AS (VALUES {_RULES}), q AS (SELECT DISTINCT item_id, unnest({_T}) AS token FROM benchmark),
        p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT item_id, page_id, round(sum(bonus), 6) AS bonus FROM q JOIN r USING (token) JOIN p ON contains(path, part) GROUP BY 1, 2""",
    "rerank_topk": f"WITH {CANDIDATES} " + _top("cand", "item_id, doc_id, score, containment", "item_id", "containment DESC, score DESC, doc_id", K),
    "hybrid_score": f"WITH {CANDIDATES}, h AS (SELECT item_id, doc_id, round(score + 2.0 * containment + CASE WHEN contains(source, '1') THEN 0.25 ELSE 0 END, 6) AS hybrid FROM cand JOIN documents USING (doc_id)) "
    + _top("h", "item_id, doc_id, hybrid", "item_id", "hybrid DESC, doc_id", K),
    "vector_topk": f"WITH {NEAR} SELECT * FROM nn",
    "dedup_first_last": f"WITH {NEAR}, g AS (SELECT query_id, label, min(rank) AS first_rank, max_by(vec_id, rank) AS vec_id FROM nn JOIN embeddings USING (vec_id) GROUP BY 1, 2) " + _top("g", "*", "query_id", "first_rank", K),
    "hit_rate_at_k": f"""WITH {NEAR}, h AS (SELECT query_id, o.label AS own, max(CAST(v.label = o.label AS INT)) AS hit FROM nn JOIN embeddings v USING (vec_id) JOIN embeddings o ON o.vec_id = query_id
        WHERE rank <= 5 AND nn.vec_id <> query_id GROUP BY 1, 2) SELECT own, count(*) AS n, round(avg(hit) * 100, 2) AS percent FROM h GROUP BY ROLLUP (own)""",
    "line_truncate": """SELECT doc_id, CASE WHEN length(text) <= 800 THEN text ELSE substr(text, 1, CASE WHEN contains(substr(text, 1, 800), chr(10)) THEN 800 - strpos(reverse(substr(text, 1, 800)), chr(10)) + 1 ELSE 800 END) || '[TRUNCATED]' END AS by_line,
        CASE WHEN length(text) <= 500 THEN text ELSE substr(text, 1, 500) || '[TRUNCATED]' END AS by_chars FROM documents""",
    "inline_comment": r"""WITH l AS (SELECT doc_id, text, trim(split_part(text, chr(10), 1)) AS line FROM documents), w AS (SELECT *, substr(line, 1, 150) AS win, substr(line, 1, 100) AS near FROM l)
        SELECT doc_id, CASE WHEN length(line) <= 100 THEN line WHEN contains(win, '.') THEN substr(line, 1, length(win) - strpos(reverse(win), '.') + 1)
        WHEN contains(near, ' ') THEN substr(near, 1, length(near) - strpos(reverse(near), ' ')) ELSE near END AS comment,
        array_to_string(list_filter(string_split(regexp_replace(regexp_extract(text, '^([^.!?]*)', 1), '[\x09-\x0D\x20]+', ' ', 'g'), ' '), lambda w: w <> '')[1:20], ' ') AS sentence FROM w""",
    "ordered_distinct": r"""WITH w AS (SELECT doc_id, lang, source, list_filter(string_split(regexp_replace(text, '[\x09-\x0D\x20]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
        u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w), f AS (SELECT doc_id, word, min(i) AS i FROM u GROUP BY 1, 2), o AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS in_order FROM f GROUP BY 1)
        SELECT w.doc_id, coalesce(in_order, '') AS in_order, len(list_distinct(list_concat(ws, [lang, source]))) AS n_union, array_to_string(list_sort(list_distinct([lang, source])), ',') AS sorted FROM w LEFT JOIN o USING (doc_id)""",
    "pass_fail_counts": r"""WITH j AS (SELECT CASE WHEN quality = 0 THEN 'positive' ELSE 'negative' END AS expectation, regexp_matches(text, '[#$%&*]{3}|!!|\|') AS m FROM documents JOIN labels USING (doc_id))
        SELECT expectation, count(*) FILTER (m) AS matching, count(*) FILTER (NOT m) AS not_matching FROM j GROUP BY 1""",
}

QUERIES = {f.__name__: f for f in (tokens, stemmed_tokens, synonym_expand, term_frequency, doc_frequency, idf, cfidf_topk, trigram_containment, keyword_boost, rerank_topk, hybrid_score, vector_topk, dedup_first_last, hit_rate_at_k, line_truncate, inline_comment, ordered_distinct, pass_fail_counts)}
