import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from photolake.llm import bpe, packing, token_files
from photolake.llm.base import table

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [(None, "a b"), (1, None), (1, ""), (1, ""), (0, "x y z"), (7, "word. " * 3000)]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path(bpe.FILE))


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder()


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.sampled_from(list("ab,.!'_ \n\t\x00 　é𝔘5s|<>") + ["<|endoftext|>", "don't"]), max_size=30).map("".join))
def test_ids_equal_the_library(coder, plain, text):
    assert coder.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids


def test_documents_and_long_texts(spark, coder, plain):
    texts = [r.text for r in table(spark, SF, "documents").collect()]
    ids, bounds = coder.encode([*texts, None], 0)
    for text, a, b in zip([*texts, ""], bounds, bounds[1:]):
        assert ids[a:b].tolist() == plain.encode(text, add_special_tokens=False).ids + [0]
    long = " ".join(texts) * 3
    assert len(long) > bpe.PART and coder.encode([long])[0].tolist() == plain.encode(long, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(docs=st.lists(st.lists(st.integers(0, 4), max_size=40), min_size=1, max_size=6), frequent=st.integers(2, 6))
def test_grammar_round_trip(docs, frequent):
    ids = np.array([x for d in docs for x in [*d, 0]], dtype=np.uint32)
    last = np.zeros(len(ids), dtype=bool)
    last[np.cumsum([len(d) + 1 for d in docs]) - 1] = True
    symbols, ends, rules = token_files.compress(ids, last, frequent)
    lengths = token_files.expansion_lengths(rules)
    grammar = token_files.Grammar(rules, lengths)
    assert grammar.expand(symbols).tolist() == ids.tolist() and len(symbols) <= len(ids) and ends.sum() == len(docs)
    cuts = np.concatenate([[0], np.flatnonzero(ends) + 1])
    for d, a, b in zip(docs, cuts, cuts[1:]):  # every document from its own symbols
        assert grammar.expand(symbols[a:b]).tolist() == [*d, 0]
    assert grammar.part(symbols, len(ids) // 3, len(ids)).tolist() == ids[len(ids) // 3:].tolist()


def test_grammar_shortens():
    ids = np.tile(np.arange(8, dtype=np.uint32), 1000)
    last = np.zeros(len(ids), dtype=bool)
    last[-1] = True
    symbols, _, rules = token_files.compress(ids, last)
    assert len(symbols) + 3 * len(rules) < len(ids) / 20


def test_token_files(spark, plain):
    docs = table(spark, SF, "documents").select("doc_id", "text").withColumn("part", F.lit("clash"))
    expected, at = {}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        expected[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.write_and_read(docs).collect()} == expected
    got = token_files.read(token_files.token_shards(spark.createDataFrame(ODD[:5], DOC)), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 1, 1] and [r.ids for r in got][2:] == [[0]] * 3
    assert token_files.write_and_read(docs.limit(0)).count() == 0


def test_written_files_are_read_by_path(spark, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    token_files.write(docs, str(tmp_path / "t"))
    assert token_files.read(spark.read.parquet(str(tmp_path / "t"))).count() == docs.count()


def test_differencing_is_near_equal():
    rng = random.Random(1)
    lengths = np.array([rng.randint(1, 256) for _ in range(400)])
    found = packing.difference(lengths, 40)
    sums = np.bincount(found, weights=lengths, minlength=40)
    assert sums.max() - sums.min() <= 4 and sums.sum() == lengths.sum()
    assert packing.difference(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=60))
def test_windows_hold_the_capacity(lengths):
    lengths = np.array(lengths)
    sums = np.bincount(packing.windows(lengths), weights=lengths)
    assert sums.max() <= packing.CAPACITY and sums.min() >= 0


def test_packing(spark, plain):
    docs = table(spark, SF, "documents").select("doc_id", "text").withColumn("offset", F.lit("clash"))
    ids = {r.doc_id: np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4") for r in docs.collect()}
    rows = packing.pack(docs, with_ids=True).toPandas().sort_values(["doc_id", "start"])
    for r in rows.itertuples():
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and list(r.ids) == own.tolist() and r.doc_tokens == len(ids[r.doc_id])
    assert (rows.groupby("doc_id").length.cumsum() - rows.length == rows.start).all()
    assert rows.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    sums = rows.groupby("sequence_id").length.sum()
    assert sums.max() <= 1024 and sums.sum() > 0.97 * 1024 * len(sums)
    odd = packing.pack(spark.createDataFrame(ODD, DOC)).collect()
    assert sum(r.doc_id == 1 for r in odd) == 3 and sum(r.length for r in odd if r.doc_id == 7) == odd[-1].doc_tokens or odd
    assert packing.pack(docs.limit(0)).count() == 0
