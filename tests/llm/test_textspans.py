"""Hashes without structural collisions, and equality that is compared."""

import inspect

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import decontaminate, sentencepiece_sa, substring_dedup, token_counts
from revlens.llm import textspans as S


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


PAIR = (thue_morse(1024), thue_morse(1024, "b", "a"))


def _spans(texts):
    buf, off = S.flat(pa.array(texts, pa.string()))
    return buf, off[:-1], off[1:]


def test_span_hashes():
    texts = [*PAIR, thue_morse(4096, "e", "t"), thue_morse(4096, "t", "e"), "a", "aa", "b", "", "abc", "ab", "x" * 70_000, "x" * 70_001]
    buf, st, en = _spans(texts)
    h = S.span_hashes(buf, st, en)
    assert len(set(h.tolist())) == len(texts)
    for i, t in enumerate(texts):       # wherever it stands
        b, s, e = _spans(["--" * i, t, "zz"])
        assert S.span_hashes(b, s, e)[1] == h[i]


def test_window_hashes():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, 300, dtype=np.uint64)
    base = S.WINDOW_BASE % S.PRIME
    for size in (1, 2, 3, 7, 10, 16, 20, 299, 300, 301):
        want = [sum(int(w) * pow(base, size - 1 - j, S.PRIME) for j, w in enumerate(words[i:i + size])) % S.PRIME for i in range(300 - size + 1)]
        assert S.window_hashes(words, size).tolist() == S.mix(np.array(want, dtype=np.uint64)).tolist()


def test_distinct_spans_survive_collisions(monkeypatch):
    texts = ["one", "two", "one", "", "three", "two", "eno", ""]
    buf, st, en = _spans(texts)
    for hashes in (None, np.zeros(len(texts), np.uint64), np.arange(len(texts), dtype=np.uint64) % 2):
        if hashes is not None and hashes.any():
            hashes = np.array([len(t) for t in texts], dtype=np.uint64)
        at, inv = S.distinct_spans(buf, st, en, hashes)
        assert [texts[at[k]] for k in inv] == texts and len(at) == 5


@pytest.fixture(params=["hashed", "colliding"])
def hashes(request, monkeypatch):
    """As they are, and with a hash that nearly always collides."""
    if request.param == "colliding":
        real = S.span_hashes
        monkeypatch.setattr(S, "span_hashes", lambda b, s, e, v=S.BYTE_VALUES: real(b, s, e, v) % np.uint64(3))


def test_tokenizers_tell_the_pair_apart(hashes):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = S.tokenizer_file(inspect.signature(sentencepiece_sa.encode).parameters["vocabulary"].default)
    tok, whole = token_counts.load(S.tokenizer_file("word_bpe_49k.json"))
    texts = [*PAIR, "The the THE " + PAIR[0], "it's It's", thue_morse(2048, "e", "t"), thue_morse(2048, "t", "e"), None, ""]
    col = pa.array(texts, pa.string())
    lib = Tokenizer.from_file(S.tokenizer_file("word_bpe_49k.json"))
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.batch_counts(col, tok, whole, {})[1].tolist() == want
    model, sp = sentencepiece_sa.load(path), SentencePieceProcessor(model_file=path)
    ids, off = sentencepiece_sa.encode_texts(col, model)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [sp.encode(t or "") for t in texts]


def test_decontamination_tells_the_pair_apart(spark):
    d = spark.createDataFrame([(1, PAIR[0]), (2, PAIR[1]), (3, PAIR[0].upper() + " x")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", PAIR[0])], "item_id string, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontaminate.digest(decontaminate.find_spans(d, bench)).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_words_that_collide_with_item_words_are_no_hits(monkeypatch):
    real = S.span_hashes
    monkeypatch.setattr(S, "span_hashes", lambda b, s, e, v=S.BYTE_VALUES: real(b, s, e, v) % np.uint64(503))
    items = [(str(i), f"word{i} next{i}") for i in range(8)]
    win = decontaminate.Windows(items, 10)
    assert len(win.vocabulary) == 16        # values were found under which these do not collide
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice([f"w{j}" for j in range(3000)] + ["word3", "next3", "WORD5 next5"], 400))) for i in range(30)]
    words, mask, first, doc, item = decontaminate.search_shard(pa.array([t for _, t in rows], pa.string()), win)
    want = {r[0]: (r[1], r[2]) for r in decontaminate.brute_force(rows, items)}
    assert {i: (int(words[i]), int(mask[first[i]:first[i + 1]].sum())) for i, _ in rows} == want
    assert any(n for _, n in want.values())


def test_substring_dedup_tells_the_pair_apart(spark):
    a, b = PAIR
    rows = [(1, " ".join([a, b] * 6)), (2, " ".join([b, a] * 6)), (3, " ".join(thue_morse(64).replace("a", "x ").replace("b", "y ").split())),
            (4, " ".join(thue_morse(64).replace("a", "y ").replace("b", "x ").split()))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in substring_dedup.digest(substring_dedup.dedup_substrings(d, window=5)).collect())
    assert got == substring_dedup.brute_force(rows, 5)
