"""Further columns with the names that operators use inside change nothing."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausegrain.llm import chat, packing, pii, ppm, secrets, urlrules, warc
from clausegrain.llm.queries import tokenizer_path

NAMES = ("length", "rank", "chunk", "piece", "key", "fp", "tokens", "host", "path", "verdict", "digest", "payload", "first", "band", "root", "n", "spans", "rendered", "unit", "block", "token", "mined", "number")
TEXTS = [(1, "call +49 170 1234567 now"), (2, None), (3, ""), (4, "password = abcdefghijkl99"), (4, "password = abcdefghijkl99"), (None, "plain words of a text " * 9)]


def clashing(df):
    return df.select("*", *(F.lit(f"clash {c}").alias(c) for c in NAMES if c not in df.columns))


@pytest.mark.parametrize("of", ["pii", "secrets", "ppm", "packing", "chat", "urlrules", "warc"])
def test_clashing_names_change_nothing(spark, of):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.example.org/x/7.html?q=1", "<p>"), (2, None, None), (3, "http://b.net/", "<p>")], "page_id long, url string, html string")
    said = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "### User: x"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    labels = clashing(spark.createDataFrame([(7, 0, 1)], "doc_id long, quality int, toxic int"))
    run, rows = {
        "pii": (pii.table_of, docs), "secrets": (secrets.table_of, docs), "ppm": (ppm.scores, docs), "packing": (lambda d: packing.pack(d, tokenizer_path()).groupBy("doc_id", "piece", "length", "ids_crc32").count(), docs),
        "chat": (lambda d: chat.digests(chat.rendered(d)), said), "urlrules": (lambda d: urlrules.judged(d, labels), pages), "warc": (lambda d: warc.captures(d).drop("archive", "offset"), pages),
    }[of]
    assert Counter(map(tuple, run(clashing(rows)).collect())) == Counter(map(tuple, run(rows).collect()))


def test_masked_texts_keep_all_columns(spark):
    docs = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    for of in (pii, secrets):
        got = of.masked(docs)
        assert got.columns == docs.columns and got.count() == len(TEXTS)
        assert {r.rank for r in got.collect()} == {"clash rank"}
