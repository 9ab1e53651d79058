"""The filter that spares rows no pair names."""

import numpy as np
import pyarrow as pa

from fieldmark.llm import ngram_join
from fieldmark.llm.words import planes


def test_filter_lets_few_other_rows_through(spark):
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(1000)], "a long, b long")
    docs = spark.range(30000).selectExpr("id doc_id", "'t' text")
    got = {r["id"] for r in ngram_join._named_rows(docs, ngram_join._filter(pairs, 1 << 15), 1 << 15).select("id").collect()}
    assert set(range(2000)) <= got and len(got) < 2500


def test_columns_are_written_once():
    h = np.repeat(np.array([5, 9, 12], np.uint64) << np.uint64(32), [2, 1, 3000])
    ids = np.concatenate([[7, 3, 4], np.arange(100, 3100)]).astype(np.int64)
    n, pos = np.full(len(h), 40), np.arange(len(h)) % 9
    block = pa.table({"part": [0], "n": [len(h)], "block": [planes(h, ids, n, pos)]})
    got = ngram_join._shared_columns((pa.scalar(0),), block).to_pylist()
    # a column of one document goes, one of many comes in bounded rows with pivots of its own
    assert [(r["h"] >> 32, r["k"], len(r["held"])) for r in got] == [(5, 2, 2), (12, 3000, 1024), (12, 3000, 1024), (12, 3000, 952)]
    assert sorted((r["h"] >> 32, e["id"], e["n"], e["pos"]) for r in got for e in r["held"]) == sorted((int(a) >> 32, *map(int, x)) for a, *x in zip(h, ids, n, pos, strict=True) if a != 9 << 32)
    assert got[0]["p0"] == 3 and all(r["p0"] == 100 and 100 <= r["p3"] < 3100 and r["n2"] == 40 for r in got[1:])
