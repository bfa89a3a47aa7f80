from __future__ import annotations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postmill.llm.rollups import TokenRollup, count_tokens, deletes, inserts, op1_token_counts, revisions
from postmill.session import shared_folder

SF = "/root/testdata/sf0.001"


def test_query_equals_plain_counts(spark):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        label, text = labels.get(r.doc_id), r.text
        if label and label.toxic == 1:
            continue
        if label and label.quality == 0:
            for mark in "#%*&$":
                text = text.replace(mark * 3, "")
        cell = (r.source, r.lang)
        n, m = want.get(cell, (0, 0))
        want[cell] = (n + 1, m + len(t.encode(text, add_special_tokens=False).ids))
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in op1_token_counts(spark, SF).collect()}
    assert got == want


@pytest.fixture
def counts(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en", 0), (2, None, "s", None, 0), (3, "", None, "en", 0), (3, "", None, "en", 0), (None, "c d e", "s", "en", 0)], "doc_id long, text string, source string, lang string, n_tokens int")
    return count_tokens(docs)


def cells(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_batches_count_once_and_survive_a_break(spark, counts):
    rollup = TokenRollup(spark, shared_folder(spark, "t"))
    assert rollup.totals().count() == 0
    assert rollup.commit("b1", inserts(counts)) and not rollup.commit("b1", inserts(counts))
    first = {("s", "en"): (2, 5), ("s", None): (1, 0), (None, "en"): (2, 0)}
    assert cells(rollup) == first
    # a batch that broke before its marker is not read, and can be sent again
    inserts(counts).write.parquet(f"{rollup.folder}/batch=b2")
    assert cells(rollup) == first
    assert rollup.commit("b2", deletes(counts.filter("doc_id = 1")))
    assert cells(rollup)[("s", "en")] == (1, 3)
    rollup.compact()
    again = TokenRollup(spark, rollup.folder)
    assert not again.commit("b1", inserts(counts)) and cells(again)[("s", "en")] == (1, 3)
    one = counts.filter("doc_id is null")
    assert again.commit("b3", revisions(one, one.selectExpr("doc_id", "source", "lang", "'v2' as tokenizer", "7L as n_tokens")))
    assert {(r.tokenizer, r.n_docs, r.n_tokens) for r in again.totals().filter("source = 's' and lang = 'en'").collect()} == {("v2", 1, 7)}
    again.compact()
    assert again.commit("b4", deletes(counts.limit(0))) and len(again.committed()) == 4 and again.totals().count() == 3
    with pytest.raises(ValueError):
        again.commit("../x", inserts(counts))
