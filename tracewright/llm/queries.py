"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, mixing, ngram_join, quality_llr, rule_ensemble, secret_scan, sentencepiece_codec, topk, toxicity, web_archive
from .common import fold, table

#: A public tokenizer's file on the driver; workers get its contents.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """Encode and decode every text: id count, digest of the ids, digest of the decoded text."""
    vocabulary = sentencepiece_codec.read_model(model)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.round_trip(docs, vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate("text", "▁", " ")).alias("same_text"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    scored = rule_ensemble.score(docs, rules)
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("secrets")).alias("spans"),
    )


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6 that SQL can express."""
    return op6_secret_scan(spark, sf_dir).drop("spans")


def op7_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = web_archive.read(web_archive.archive(table(spark, sf_dir, "pages")))
    number = lambda c: F.col(c).try_cast("long")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_language_id, op3_ngram_jaccard_join, op4_quality_classifier, op5_source_mixing, op6_secret_scan, secret_base_spans, op7_web_archive, op8_topk_search, op9_toxicity, op10_quality_rules, pipeline)
}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP3 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
reps AS (SELECT t, min(doc_id) AS rep, count(*) AS n_copies FROM d GROUP BY t),
w AS (SELECT rep, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM reps),
s AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS rep, least(a, min(b)) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS rep, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, CASE WHEN n.rep IS NULL THEN d.doc_id ELSE coalesce(class_id, reps.rep) END AS class_id,
  coalesce(n_links, 0)::BIGINT AS n_links, CASE WHEN n.rep IS NULL THEN d.doc_id ELSE reps.rep END AS rep_id,
  CASE WHEN n.rep IS NULL THEN 1 ELSE n_copies END::BIGINT AS n_copies
FROM d JOIN reps ON d.t = reps.t LEFT JOIN n ON n.rep = reps.rep LEFT JOIN class ON class.rep = reps.rep LEFT JOIN deg ON deg.rep = reps.rep
"""

#: The base kinds of op6; its further spans are the lexer's and not in SQL.
OP6_BASE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT 0 AS kind, 'assign' AS name, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p, 1 AS g, 6 AS least
 UNION ALL SELECT 1, 'access', '(AKIA[A-Z0-9]+)', 1, 20 UNION ALL SELECT 2, 'hex', '([0-9a-f]+)', 1, 24),
m AS (SELECT doc_id, kind, name, least, regexp_extract_all(t, p, 0) AS whole, regexp_extract_all(t, p, 1) AS part, regexp_split_to_array(t, p) AS gaps FROM d, k),
s AS (SELECT doc_id, kind, name, least, unnest(whole) AS w, unnest(part) AS v, unnest(range(1, len(whole) + 1)) AS i, whole, gaps FROM m),
f AS (SELECT doc_id, kind, name, list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: len(x))), 0)::BIGINT AS b, len(w) AS n FROM s WHERE len(v) >= least)
SELECT d.doc_id, count(*) FILTER (name = 'assign')::BIGINT AS n_assign, count(*) FILTER (name = 'access')::BIGINT AS n_access, count(*) FILTER (name = 'hex')::BIGINT AS n_hex, sha256(coalesce(string_agg(name || ':' || b || ':' || (b + n), ',' ORDER BY b, kind), '')) AS base_sha256
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP7 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(h, i::INT, 1))]), '') AS b FROM p),
d AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * substr(b, (5*k+1)::INT, 1)::INT + 8 * substr(b, (5*k+2)::INT, 1)::INT + 4 * substr(b, (5*k+3)::INT, 1)::INT
      + 2 * substr(b, (5*k+4)::INT, 1)::INT + substr(b, (5*k+5)::INT, 1)::INT)::INT, 1)), '') AS g FROM bits),
m AS (SELECT *, max(page_id) OVER (PARTITION BY g, n) AS newest FROM d)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to FROM m
"""

OP8 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS qr, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, qr ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, {WORDS}::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]')) AS chars FROM documents),
k AS (SELECT *, chars / greatest(size, 1) AS mean,
    (('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || size)[1:12])::BIGINT + 0.5) / 281474976710656 AS u FROM d),
q AS (SELECT *, -ln(u) / greatest(0.25, least(1.0, mean / 4, 10.0 / greatest(mean, 1e-9))) AS key FROM k),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM s),
x AS (SELECT *, [3.0, 1.0, 2.0][((turn - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
y AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
z AS (SELECT *, (SELECT level FROM y WHERE cap >= level * weight ORDER BY cap / weight, turn LIMIT 1) AS final FROM y),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM z),
r AS (SELECT q.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY q.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target - epochs * source_size - before + 1e-6))))::BIGINT AS taken FROM r
"""

ORACLE_SQL = {"secret_base_spans": OP6_BASE, "op3_ngram_jaccard_join": OP3, "op5_source_mixing": OP5, "op7_web_archive": OP7, "op8_topk_search": OP8}
