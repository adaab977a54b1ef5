"""Token counts and SentencePiece against the libraries themselves."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revlens.llm import sentencepiece_sa, textspans, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = ["", None, " ", "á x y", "<|endoftext|>hi <|startoftext|>", "don't it's I'M he'LL !!'s 'twas", "ΑΣ σς Σ", "日本語 テスト 123", "a" * 3000,
       "x y\x0bz\x0cq\x1cA\x85b", "İI ŉ ſ", "a ́b é", "\x00 a\x00b", "ﬁ ½ ×÷", "  two  blanks\n\n\ttabs", "▁a▁▁b", "def f(x):\r\n    return x**2",
       "русский العربية हिन्दी 👩‍👩‍👧", "=" * 70 + ">", "12345.678,9"]
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aeinrst THE'.,!<|>0159\n\t▁éßœ"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def model():
    return sentencepiece_sa.load(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def _counts(texts, counter):
    return token_counts.batch_counts(pa.array(texts, pa.string()), *counter, {})[1].tolist()


def _ids(texts, model):
    ids, off = sentencepiece_sa.encode_texts(pa.array(texts, pa.string()), model)
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


def test_counts_of_odd_texts(counter):
    assert _counts(ODD, counter) == [len(counter[0].encode(t or "", add_special_tokens=False)) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_counts_equal_the_library(counter, texts):
    assert _counts(texts, counter) == [len(counter[0].encode(t, add_special_tokens=False)) for t in texts]


def test_ids_of_odd_texts(model, library):
    assert _ids(ODD, model) == [library.encode(t or "") for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_ids_equal_the_library(model, library, texts):
    assert _ids(texts, model) == [library.encode(t) for t in texts]


def test_pieces_in_any_order(model, library):
    import random

    rng = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(400)]
    assert _ids(texts, model) == [library.encode(t) for t in texts]


def test_round_trip(spark, docs):
    enc = sentencepiece_sa.encode(docs)
    got = enc.collect()
    assert len(got) == docs.count()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    back = {(r["doc_id"], r["text"]) for r in sentencepiece_sa.decode(enc).collect()}
    assert back == {(i, (t or "").replace("▁", " ")) for i, t in texts}
    assert [r["doc_id"] for r in got if not r["round_trip"]] == [9]


def test_empty_tables(none):
    assert sentencepiece_sa.encode(none).collect() == []
    assert token_counts.count_tokens(none).collect() == []


def test_count_columns(docs, counter):
    got = token_counts.count_tokens(docs, limit=100).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["over_limit"] == (r["n_tokens"] > 100)
    assert [(r["n_bytes"], r["n_tokens"]) for r in got if r["doc_id"] == 3] == [(0, 0)]


def test_word_spans_stay_inside_documents():
    buf, off = textspans.flat(pa.array(["ab cd", None, "ef", "", " g"]))
    s, e = textspans.word_spans(buf, off, textspans.NOT_BLANK)
    assert [buf[a:b].tobytes() for a, b in zip(s, e)] == [b"ab", b"cd", b"ef", b"g"]
    assert textspans.per_document(s, off).tolist() == [0, 2, 2, 3, 3, 4]
