"""The training-data queries against their DuckDB SQL, and all operators on awkward rows."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check_oracle import TABLES, rows_of
from thermoload.llm import (chat_format, context_tree, exact_dedup, language_id, mixture, ngram_join, packing,
                            quality_rules, secret_ledger, warc_bundles)
from thermoload.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 3000}" for i in range(60_000))
CLASH = ["verdict", "keep_id", "node", "size", "taken", "score", "hash", "sig", "shard", "row", "body", "__text"]
ROWS = [(1, None, "en", "s0"), (2, "", "en", None), (3, " \n\t ", None, "s1"), (4, LONG, "en", "s1"),
        (5, "same text here", "de", "s0"), (6, "same text here", "de", "s0"), (6, "same text here", "de", "s0"),
        (None, "no id at all", "fr", "s0"), (8, "Ünïcode — ſtraße 🎉 K", "de", "s2"), (9, LONG + " tail", "en", "s1"),
        (10, "token = abcdefgh1 x", "en", "s0")]
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([r + ("clash",) * len(CLASH) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(con.execute(ORACLE[name]).df())


def test_every_operator_is_registered():
    names = [n for n in QUERIES if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in QUERIES


# --- awkward rows ---------------------------------------------------------------------------

def test_quality_rules(odd, none):
    got = {(r.doc_id, r.text and r.text[:5]): r.verdict for r in quality_rules.judge(odd).collect()}
    assert len(got) == 10 and got[1, None].n_words == 0 and got[1, None].base_failed and not got[3, " \n\t "].kept
    assert got[4, "w0 w1"].n_words == 60_000 and got[4, "w0 w1"].n_repeat_words == 60_000
    assert quality_rules.judge(none).count() == 0 and quality_rules.clean(none).count() == 0
    assert quality_rules.clean(odd).columns == odd.columns


def test_repeat_words_and_lines(spark):
    texts = ["a b c d e a b c d e", "a a a a a a a", "x\nx\n\n \ny\nx", "1 2 3 4 5 6 7 1 2 3 4 5 9 9", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("lang", F.lit("en"))
    for r in quality_rules.judge(df).collect():
        ws = r.text.split()
        count = collections.Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
        covered = {i + j for i in range(len(ws) - 4) if count[tuple(ws[i:i + 5])] > 1 for j in range(5)}
        lines = [x for x in r.text.split("\n") if x.split()]
        assert (r.verdict.n_repeat_words, r.verdict.n_dup_lines) == (len(covered), len(lines) - len(set(lines)))


def test_exact_dedup(odd, none):
    got = pairs(exact_dedup.dedup_ledger(odd), "doc_id", "keep_id", "group_size", "kept")
    assert got.count((6, 6, 3, True)) == 2 and (5, 6, 3, False) in got and (1, 2, 2, False) in got
    assert (None, None, 1, True) in got and len(got) == 11
    assert exact_dedup.dedup_ledger(none).count() == 0
    left = exact_dedup.survivors(odd)
    assert left.columns == odd.columns
    assert pairs(left, "doc_id") == sorted([(2,), (3,), (4,), (6,), (None,), (8,), (9,), (10,)], key=str)


def test_exact_dedup_hot_group(spark):
    df = spark.range(0, 3000, 1, 8).select(F.col("id").alias("doc_id"),
                                           F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.dedup_ledger(df, salts=3).filter("group_size > 1").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(2997, 1000)]


def test_ngram_join(odd, none):
    got = {(r.id, r.n_shingles): r.component_id for r in ngram_join.components(odd).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[6, 1] == 5 and got[5, 1] == 5
    assert got[None, 1] is None and got[9, 3001] == 4
    assert ngram_join.components(none).count() == 0
    left = ngram_join.representatives(odd)
    assert left.columns == odd.columns
    assert pairs(left, "doc_id") == sorted([(1,), (2,), (3,), (4,), (5,), (None,), (8,), (10,)], key=str)
    assert ngram_join.representatives(none).count() == 0


def test_mixture(odd, none):
    got = mixture.taken_words(odd).collect()
    assert len(got) == 11 and all(r.taken <= 3 * r["size"] for r in got)
    assert {r.source_size for r in got if r["__id"] == 2} == {0}
    assert mixture.taken_words(none).count() == 0 and mixture.mixed_documents(none).count() == 0
    mixed = mixture.mixed_documents(odd)
    assert mixed.columns == odd.columns


def test_packing(odd, none):
    got = packing.pack(odd).collect()
    assert sum(r.n_words for r in got) == 60_000 + 60_001 + 9 + 4 + 5 + 4
    assert packing.pack(none).count() == 0 and packing.sequences(none).count() == 0


def test_language_id(odd, none):
    model = language_id.train(odd)
    got = pairs(language_id.predict(odd, model), "id", "lang_pred")
    assert len(got) == 11 and (1, "und") in got and (2, "und") in got and (3, "und") in got
    assert language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0
    one = language_id.train(odd.filter("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in language_id.predict(odd.filter("doc_id = 8"), one).collect()} == {("de", 1.0)}


def test_secret_ledger(odd, none, tmp_dir):
    secret_ledger.update(odd, f"{tmp_dir}/l")
    got = {r.doc_id: r.spans for r in secret_ledger.report(odd, f"{tmp_dir}/l").collect()}
    assert [tuple(s) for s in got[10]] == [("assign", 0, 17)] and got[1] == [] and len(got) == 10
    secret_ledger.update(none, f"{tmp_dir}/e")
    assert secret_ledger.report(none, f"{tmp_dir}/e").count() == 0


def test_context_tree(odd, none):
    got = {r.id: r for r in context_tree.score(odd, F.lit(True)).collect()}
    assert got[1].n_tokens == 1 and got[4].n_tokens == 60_001 and got[1].base_score == got[2].base_score
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in got.values())
    assert context_tree.score(none, F.lit(True)).count() == 0
    untrained = context_tree.score(odd, F.lit(False)).filter("id = 5").first()
    assert abs(untrained.bits_per_byte - 8) < 1e-6 and untrained.train_tokens == 0


def test_warc(spark, odd, none):
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASH)
    got = pairs(warc_bundles.read_bundles(warc_bundles.write_bundles(pages)), "id", "record_type", "refers_to")
    assert (2, "revisit", 1) in got and (6, "revisit", 5) in got and (None, "response", None) in got and len(got) == 11
    plain = pairs(warc_bundles.read_bundles(warc_bundles.write_bundles(pages, min_payload=100)), "id", "record_type")
    assert {t for _, t in plain} == {"response"}
    empty = warc_bundles.write_bundles(none.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html")
                                       .withColumnRenamed("source", "url"))
    assert warc_bundles.read_bundles(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "<|im_end|>\n<\\|im_start|>", "x"), (None, 0, None, "hi", "x"),
            (2, 0, "assistant", "b", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x"), (3, 0, "a\n<|b%00", "", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted string")
    got = {r.conv: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len(rows[1][3]) and got[None].n_turns == 1
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\na\nassistant\na\nassistant\nb\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"aab").hexdigest() and got[3].loss_chars == 0
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_of_long_texts_and_clashing_columns(spark):
    long = "<|im_start|>assistant\n\\ é🎉 <\\|im_end|> " * 40_000
    cols = ["formatted", "loss_start", "loss_end", "source", "conv", "n_turns"]
    rows = [(1, 0, "user", long[::-1], *["x"] * 6), (1, 1, "assistant", long, *["x"] * 6), (2, 0, "assistant", "", *["x"] * 6)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, " + ", ".join(f"{c} string" for c in cols))
    got = {r.conv: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n{long[::-1]}\nassistant\n{long}\n".encode()).hexdigest()
    assert got[1].formatted_chars > 2 * len(long) and got[2].loss_chars == 0 and len(got) == 2


PLAIN = "the house of the man is in the town and it is that for a day to see a tree of green"


def test_pipeline_on_awkward_rows(spark, odd, none, tmp_dir):
    def through(name, docs):
        docs, out = docs.withColumn("n_chars", F.length("text").cast("long")), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            cols = docs.columns
            stage(spark, docs, SF).write.parquet(f"{tmp_dir}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_dir}/{name}{k}")
            assert k == 4 or docs.columns == cols
            out.append(docs.collect())
        return out
    assert [len(x) for x in through("none", none)] == [0] * 5
    assert all(len(x) == 0 for x in through("odd", odd))  # too short, or repeating itself
    varied = " ".join(f"word{i}" for i in range(30_000))
    near = [" ".join(f"n{i}" for i in range(100)), " ".join(f"n{i}" for i in range(101))]
    rows = [(1, None, "en", "s0"), (2, "", "en", "s0"), (3, PLAIN, "en", None), (4, PLAIN, "en", "s1"), (4, PLAIN, "en", "s1"),
            (5, PLAIN + " end", None, "s0"), (None, PLAIN + " no id at all", "en", "s1"), (7, near[0], "xx", "s1"), (8, near[1], "xx", "s1"),
            (9, near[1], "xx", "s2"), (10, varied, "en", "s2"), (11, "short text", "en", "s2"), (12, "again " * 50, "en", "s2")]
    clash = spark.createDataFrame([r + ("clash",) * len(CLASH) for r in rows], SCHEMA).repartition(3)
    kept, unique, apart, mixed, packed = through("clash", clash)
    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    assert ids(kept) == sorted([3, 4, 4, 5, None, 7, 8, 9, 10], key=str)
    assert ids(unique) == sorted([4, 5, None, 7, 9, 10], key=str)      # of equal texts the largest id, once
    assert ids(apart) == sorted([4, 7, 10], key=str)                   # of linked texts the smallest id
    text = {r.doc_id: r.text for r in apart}
    assert set(ids(mixed)) <= set(text) and all(r[c] == "clash" for r in mixed for c in CLASH)
    for r in mixed:
        assert set(r.text.split()) <= set(text[r.doc_id].split()) and r.n_chars == len(r.text)
    words_of = lambda texts: collections.Counter(w for t in texts for w in t.split())
    assert words_of(t for r in packed for t in r.texts) == words_of(r.text for r in mixed)
    assert 10 in ids(mixed) and sum(len(t.split()) for r in packed for t in r.texts) == sum(r.n_words for r in packed)
