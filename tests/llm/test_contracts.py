"""The registered queries' contracts, checked by other means than the operators' own code."""

import hashlib
import time
import zlib

import duckdb
import numpy as np
import pytest

from tracewright.llm import language_id, ngram_join, queries, secret_scan, sentencepiece_codec, toxicity

DATA = "/root/testdata/sf0.001"
def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def test_secret_base_spans_agree_with_sql(spark):
    data, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.secret_base_spans(spark, data).collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL["secret_base_spans"]).fetchall()) and sum(r[1] for r in got) > 0


FORMS = [
    "<password>hunter22x</password>", "tool --password hunter22x -v", 'db.credential = """hunter22x"""', "authkey = <<EOF\nhunter22x\nEOF\n", "passphrase: |\n  hunter22x\nb: 1",
    'config["api"]["key"] = "hunter22x"', 'auth_key: str = "hunter22x"', 'k = "hunter22x"\ndb.credential = k', "<key>dbPassphrase</key><string>hunter22x</string>", "DB_PWD=hunter22x",
]


@pytest.mark.parametrize("text", FORMS)
def test_lexer_adds_what_the_base_kinds_miss(text):
    at = text.index("hunter22x")
    assert (at, "literal", at + 9) in secret_scan.spans(text) or any(k == "assign" and s <= at and at + 9 <= e for s, k, e in secret_scan.spans(text))
    clean = text.replace("password", "colour").replace("credential", "colour").replace("passphrase", "colour").replace("Passphrase", "Colour")
    for name in ('"api"', "auth", "PWD"):
        clean = clean.replace(name, '"x"' if name[0] == '"' else "hue")
    assert secret_scan.spans(clean) == []


@pytest.mark.parametrize("text", ["token " + "x" * 200_000, "token " + "a." * 100_000, "token " + '\\"' * 100_000, "token " + "<a>" * 66_000, "token " + "".join(f"x = <<E{i}\n" for i in range(20_000)), "k = k + k\n" * 20_000 + "token", "token: |\n" * 22_000])
def test_lexer_takes_time_in_proportion(text):
    began = time.time()
    secret_scan.spans(text)
    assert time.time() - began < 5


def test_filter_tables_equal_a_plain_convolution():
    rng = np.random.default_rng(1)
    net = language_id.train([(bytes(rng.integers(97, 100 + 9 * k, 60).astype(np.uint8)), f"l{k}") for k in (0, 1) for _ in range(30)], steps=20)
    w = rng.integers(0, 256, (5, language_id.WINDOW)).astype(np.uint8)
    pooled = []
    for width in language_id.WIDTHS:
        one_hot = np.eye(256)[w]
        r = sum(one_hot[:, k : language_id.WINDOW - width + 1 + k] @ net.filters[width][k] for k in range(width))
        pooled.append(r.max(axis=1))
    z = np.maximum(np.concatenate(pooled, axis=1) + net.bias, 0) @ net.dense + net.offset
    assert np.allclose(net.probabilities(w), language_id.softmax(z), atol=1e-4)


def test_join_finds_planted_pairs_of_every_likeness(spark):
    rng = np.random.default_rng(9)
    rows, share = [], {}
    for i in range(240):
        words = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
        swapped = list(words)
        for at in rng.choice(300, i % 12, replace=False):  # each change costs up to five shingles
            swapped[at] = f"n{i}x{at}"
        sets = [{tuple(t[k : k + 5]) for k in range(296)} for t in (words, swapped)]
        share[i] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(swapped) + ("" if i % 12 else " end"))]
    got = {r.doc_id: r.class_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [i for i, s in share.items() if low <= s < high]
        assert len(band) >= 10 and all(got[2 * i] == got[2 * i + 1] for i in band)
    assert all(got[2 * i] != got[2 * i + 1] for i, s in share.items() if s < 0.79)


def test_digits_belong_to_words():
    assert toxicity.words_of("st0pid idi0t x_y") == ["st0pid", "idi0t", "x", "y"]
    rng = np.random.default_rng(0)
    model = toxicity.SubwordModel(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.0, np.ones(len(toxicity.TOPS) + 1), 0.0)
    texts = ["one st0pid", None, "", "x" * 100_000, "a b c d e f g"]
    assert np.allclose(model.scores(texts), [model.score(t) for t in texts])
    long = "ab" * 500
    assert model.word_values([long + "c"])[0] != model.word_values([long + "d"])[0]


@pytest.mark.parametrize("name, fold, bar", [("op4_quality_classifier", 5, 0.3), ("op9_toxicity", 5, 0.5)])
def test_scored_queries_keep_their_contract(spark, texts, name, fold, bar):
    rows = queries.QUERIES[name](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id, fold) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= bar) for r in rows)


def test_language_query_keeps_its_contract(spark, texts):
    rows = queries.op2_language_id(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)


def test_sentencepiece_query_agrees_with_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    for r in queries.op1_sentencepiece(spark, DATA).collect():
        ids = sp.encode(texts[r.doc_id])
        assert r.n_ids == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.same_text


@pytest.mark.parametrize("held_out", ["op4_quality_classifier", "op9_toxicity"])
def test_held_out_figures(spark, held_out):
    """On the largest test data: nine of ten found, at most three of a hundred others flagged."""
    data, label = "/root/testdata/sf0.1", "quality" if "quality" in held_out else "toxic"
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = [(marks[r.doc_id], r.predicted) for r in queries.QUERIES[held_out](spark, data).collect() if r.held_out and marks.get(r.doc_id) is not None]
    assert np.mean([p for y, p in rows if y == 1]) >= 0.9 and np.mean([p for y, p in rows if y == 0]) <= 0.03


def test_empty_tables_and_clashing_names(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "doc_id long, text string, secrets string, ids string, score string")
    assert secret_scan.scan(empty).count() == 0 and sentencepiece_codec.encode(empty, sentencepiece_codec.read_model(queries.TOKENIZER)).count() == 0
    assert toxicity.score(empty, toxicity.SubwordModel()).count() == 0
    from tracewright.llm import quality_llr, topk

    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_llr.judge(empty, lab).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).count() == 0
    clash = spark.createDataFrame([(1, "a b c " * 30, "x", "y", "z", "w", "v")], "doc_id long, text string, w string, hashes string, ordered string, again string, pairs string")
    assert quality_llr.judge(clash, lab).first().n_words == 90
    some = spark.createDataFrame([(1, [1.0], "x"), (50, [2.0], "y")], "vec_id long, embedding array<double>, mark string")
    assert [tuple(r) for r in topk.search(some, F.col("id") % 50 == 0).collect()] == [(50, 1, 1, 512 * 256)]
