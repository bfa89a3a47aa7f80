from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postmill.llm.packing import Bins, op6_best_fit_packing, pack_documents
from postmill.llm.tokens import Encoder, encoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab c  \n\t 　 \x1cé'sll!?12 <|>"), max_size=60))
def test_ids_equal_the_tokenizers_file(text):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))) if not hasattr(test_ids_equal_the_tokenizers_file, "t") else test_ids_equal_the_tokenizers_file.t
    test_ids_equal_the_tokenizers_file.t = t
    t.encode_special_tokens = True
    ids = t.encode(text, add_special_tokens=False).ids
    assert encoder().ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_long_texts_are_encoded_stretch_by_stretch(reference, monkeypatch):
    monkeypatch.setattr("postmill.llm.tokens.STRETCH", 50)
    text = " ".join(random.Random(3).choice(["alpha", "bé", "x,", "12", "<|endoftext|>"]) for _ in range(400))
    ids = reference(text)
    assert Encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken"))).ids(text) == struct.pack(f"<{len(ids)}I", *ids)


def check(rows, texts, reference, size):
    """Every id of every document once and in order, sequences without gaps or overlap."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids, at = [*reference(text), 2], 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            assert r.length == size or k == 0
            at += r.length
        assert at == len(ids)
        assert len(ids) > size or len(by_doc[doc]) == 1
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


def test_query_packs_every_document(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op6_best_fit_packing(spark, SF).collect()
    used = check(rows, {r.doc_id: r.text for r in docs.collect()}, reference, 1024)
    assert used <= 1.03 * sum(r.length for r in rows) / 1024 + 2


def test_odd_rows(spark, reference):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "<|endoftext|>", 5: "a  b\n c ", 6: "same", 7: "same", None: "no id"}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, length int")
    got = pack_documents(docs, size=64, open_bins=2, ids=True)
    check(got.collect(), texts, reference, 64)
    assert sum(got.select("ids").toPandas().ids.map(len)) == sum(r.length for r in got.collect())
    assert pack_documents(docs.limit(0)).count() == 0
    assert pack_documents(docs.union(docs)).count() == 2 * pack_documents(docs).count()


def test_bins_are_bounded_and_the_fullest_closes_first():
    bins = Bins(10, 2, 0)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # best fit: exactly full
    assert bins.place(8) == (2, 0)
    assert bins.place(5) == (3, 0) and bins.open == 2  # sequence 2 was the fullest
    assert bins.place(4) == (0, 6)
