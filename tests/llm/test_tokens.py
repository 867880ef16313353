import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import tokens
from tallyweave.llm.codes import BLOCK, Codes, pack


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.vocabulary())


def brute(tokenizer, rows):
    """(doc_id, start, n_tokens, crc) in order of the ids."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [tokens.SEGMENT, 100])
def test_query_against_the_library(spark, folder, given, tokenizer, monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    rows = sorted((r["doc_id"], r["text"]) for r in given("documents"))
    got = tokens.op11_addressable_codes(spark, folder)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(tokenizer, rows)


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1))), st.data())
def test_codes(numbers, data):
    codes = Codes(pack(np.array(numbers, dtype=np.uint32)))
    assert len(codes) == len(numbers) and codes.between(0, len(codes)).tolist() == numbers
    a = data.draw(st.integers(0, len(numbers)))
    b = data.draw(st.integers(a, len(numbers)))
    assert codes.between(a, b).tolist() == numbers[a:b]
    places = data.draw(st.lists(st.integers(0, len(numbers) - 1))) if numbers else []
    assert codes.at(places).tolist() == [numbers[i] for i in places]


def test_codes_around_blocks():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK, 10_007):
        numbers = rng.integers(0, 1 << rng.integers(1, 33, size=size), dtype=np.uint64).astype(np.uint32)
        codes = Codes(pack(numbers))
        assert np.array_equal(codes.at(np.arange(size)), numbers)
        for a in range(0, size, 61):
            assert np.array_equal(codes.between(a, min(size, a + 130)), numbers[a : a + 130])
    with pytest.raises(IndexError):
        codes.at([size])
    with pytest.raises(ValueError):
        Codes(b"something else")


def test_a_number_takes_a_byte_of_each_of_its_levels():
    small, large = pack(np.zeros(8192, dtype=np.uint32)), pack(np.full(8192, 300, dtype=np.uint32))
    assert len(small) - 16 == 8192
    # The bitmap takes a bit and its directory an eighth of that.
    assert len(large) - 24 == 2 * 8192 + 8192 // 8 * 9 // 8


ODD = ["", " ", "a", " a  b ", "a \n b", "a  b", "　x  y", "one  two   three", "tail ", "x\x1c y", "l'été à la café's 12 345"]


@settings(max_examples=150, deadline=None)
@cases(st.lists(st.text(alphabet="ab 1.'\n\t 　é\x1c<|endoftext|>"), max_size=5))
def test_words_have_the_ids_of_the_whole_text(texts):
    tokenizer = Tokenizer.from_file(tokens.vocabulary())
    encoder = tokens.Encoder(tokenizer.to_str())
    assert encoder.by_word
    texts = [*texts, *ODD, "<|endoftext|> <|endoftext|>"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # Also where a part of an array is given, and words are known.
    for begin in (0, 2, 0):
        ids, sizes = encoder.ids(pa.array(texts, pa.string())[begin:], 9)
        assert ids.tolist() == [i for w in want[begin:] for i in [*w, 9]]
        assert sizes.tolist() == [len(w) + 1 for w in want[begin:]]
    assert [x.tolist() for x in encoder.ids(pa.array([], pa.string()), 9)] == [[], []]


def test_forgetting_words(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    encoder = tokens.Encoder(tokenizer.to_str())
    for text in ("a b c d", "c d e", "e f g h i j", "a j"):
        assert encoder.ids(pa.array([text]), 0)[0].tolist() == [*tokenizer.encode(text).ids, 0]


def test_other_vocabularies_encode_whole_texts(spark, tmp_path):
    """One that lower-cases and drops white space."""
    name = tokens.vocabulary("word_bpe_49k.json")
    other = Tokenizer.from_file(name)
    assert not tokens.Encoder(open(name, encoding="utf-8").read()).by_word
    docs = spark.createDataFrame([(1, "Some Words  here"), (2, "and more")], "doc_id long, text string")
    tokens.write(docs, str(tmp_path / "out"), name, end=49407)
    got = tokens.documents(spark, str(tmp_path / "out")).orderBy("doc_id").collect()
    want = [[*other.encode(t, add_special_tokens=False).ids, 49407] for t in ("Some Words  here", "and more")]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want


@pytest.mark.parametrize("parts", [tokens.PARTS, 0])
def test_any_place_can_be_read(spark, tmp_path, monkeypatch, tokenizer, parts):
    monkeypatch.setattr(tokens, "SEGMENT", 50)
    monkeypatch.setattr(tokens, "PARTS", parts)
    texts = ["many words of text " * n for n in (1, 40, 3, 0, 7, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = str(tmp_path / "out")
    tokens.write(docs, path)
    every = [i for t in texts for i in [*tokenizer.encode(t).ids, 0]]
    assert tokens.segments(spark, path).count() > 1
    wanted = [0, 3, 3, len(every) - 1, len(every), -1, None, *range(40, 90)]
    places = spark.createDataFrame([(p,) for p in wanted], "place long").withColumn("codes", F.lit("clash"))
    got = {r.place: r.id for r in tokens.ids_at(path, places).collect()}
    assert got == {p: every[p] for p in set(wanted) if p is not None and 0 <= p < len(every)}


def test_odd_rows(spark, tmp_path, tokenizer):
    rows = [(3, None), (None, "no id"), (2, ""), (7, "twice"), (7, "twice"), (7, "other"), (1, "long " * 200_000), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("part", "hash", "spread", "codes")})
    tokens.write(docs, str(tmp_path / "odd"))
    got = tokens.documents(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 3, 7, 7, 7]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:n]) for n in range(len(got))]
    size = {t: len(tokenizer.encode(t or "").ids) + 1 for _, t in rows}
    assert sorted(r.n_tokens for r in got) == sorted(size[t] for _, t in rows)
    # Equal rows stand together.
    assert size["twice"] in [r.n_tokens for r in got[6:7]]
    tokens.write(docs.limit(0), str(tmp_path / "empty"))
    assert tokens.documents(spark, str(tmp_path / "empty")).collect() == []
    assert tokens.ids_at(str(tmp_path / "empty"), spark.createDataFrame([(0,)], "place long")).collect() == []


def test_ids_of_other_types(spark, tmp_path):
    docs = spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")
    tokens.write(docs, str(tmp_path / "out"))
    assert [r.doc_id for r in tokens.documents(spark, str(tmp_path / "out")).orderBy("start").collect()] == ["a", "b"]

