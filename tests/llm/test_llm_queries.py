"""Registered queries, on the smallest tables, against brute force or their SQL."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from logfathom.llm import bpe, toxicity
from test_llm_operators import near_groups

SMALL = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_every_operator_is_registered():
    names = [name.split("_")[0] for name in contract.LLM if name.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 14)) and "pipeline" in contract.LLM
    assert set(contract.LLM_SQL) <= set(contract.LLM)


@pytest.mark.parametrize("name", sorted(contract.LLM_SQL))
def test_query_equals_its_sql(spark, name):
    df = contract.LLM[name](spark, SMALL)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    result = con.execute(contract.LLM_SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(result.fetchall())


def test_token_counts(spark):
    import tiktoken
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    docs, last = documents(spark), {}
    for r in docs.values():
        last[r.text] = max(r.doc_id, last.get(r.text, -1))
    want = defaultdict(lambda: [0, 0])
    for r in docs.values():
        if last[r.text] == r.doc_id:
            total = want[r.source, r.lang, "byte_bpe_50k"]
            total[0] += 1
            total[1] += len(encoding.encode_ordinary(r.text)) + 1
    rows = contract.LLM["op2_token_counts"](spark, SMALL).collect()
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in rows} == dict(want)


def test_token_counts_of_rows_without_an_own_id(spark, tmp_path):
    rows = [(None, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "c d e", "s", "en"), (2, "f", "s", "en"),
            (None, "only here", "s", "en"), (None, "only here", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(
        str(tmp_path / "documents.parquet"))
    [row] = contract.LLM["op2_token_counts"](spark, str(tmp_path)).collect()
    import tiktoken
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    kept = ["a b", "c d e", "f", "only here"]
    assert (row.docs, row.tokens) == (4, sum(len(encoding.encode_ordinary(t)) + 1 for t in kept))


def test_pipeline(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    scores = toxicity.scores(frame, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()
    docs = documents(spark)
    clean = [r.doc_id for r in scores if not r.predicted]
    assert 0 < len(docs) - len(clean) < len(docs) / 3
    last = {}
    for i in sorted(clean):
        last[docs[i].text] = i
    kept = [(i, docs[i].text) for i in sorted(last.values())]
    kept = [i for i, _, component in near_groups(kept) if i == component]
    assert len(kept) < len(clean) < len(docs)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    ids = {i: tokenizer.encode(docs[i].text, add_special_tokens=False).ids + [1] for i in kept}
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, r.length))
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(piece)
    assert set(found) == set(kept)
    for i, pieces in found.items():
        end = 0
        for start, length in sorted(pieces):
            assert start == end
            end += length
        assert end == len(ids[i])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
