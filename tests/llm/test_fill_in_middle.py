"""Fill-in-middle cuts against the unit pattern, and the Fenwick index alone."""

import random
import re

import numpy as np
import pytest

from revlens.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _random_text(rng, n):
    return "".join(rng.choice(["a", "word", "é", "日本", "😀", " ", "  ", "\n", "\t", "\x0b", " ", "\u0085", "\x00", "x" * 9]) for _ in range(n))


@pytest.mark.parametrize("block", [1, 3, 8, 2048])
def test_every_cut_of_a_text(block):
    rng = random.Random(block)
    for text in ["", " ", "one", " one", "one ", "\n\n", *(_random_text(rng, rng.randint(1, 60)) for _ in range(40))]:
        units, raw = UNIT.findall(text), text.encode()
        index = fim.Units(np.frombuffer(raw, np.uint8), block)
        assert (index.n_units, index.n_chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head))


def test_slabs_of_a_long_text(monkeypatch):
    monkeypatch.setattr(fim, "SLAB", 64)
    text = _random_text(random.Random(3), 500)
    index, units = fim.Units(np.frombuffer(text.encode(), np.uint8), 16), UNIT.findall(text)
    assert [index.cut(k)[1] for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_fenwick_descent():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 8, 100):
        units, chars = rng.integers(0, 4, n), rng.integers(0, 9, n)
        tree, upto = fim.Fenwick(units, chars), np.cumsum(units)
        for k in range(1, int(upto[-1]) + 1):
            at = int(np.searchsorted(upto, k))
            assert tree.descend(k) == (at, int(units[:at].sum()), int(chars[:at].sum()))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert _rows(fim.digest(fim.transform(docs))) == sorted(fim.brute_force(rows), key=str)
    assert fim.transform(none).collect() == []


def test_all_forms_round_trip(spark):
    rng = random.Random(7)
    texts = [None, "", " \n", "has <P> inside", "<M>", "ends with <", "<S", "> starts", *(_random_text(rng, rng.randint(1, 30)) for _ in range(200)),
             *("< <S > P> <P" for _ in range(30)), " ".join(["long"] * 200_000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, output string")
    cut = fim.transform(d, block=8)
    assert _rows(fim.digest(cut)) == sorted(fim.brute_force(rows), key=str)
    back = {r["doc_id"]: r["t"] for r in cut.select("doc_id", fim.restore(cut["output"], cut["form"]).alias("t")).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert {r["form"] for r in cut.select("form").distinct().collect()} == {"plain", "psm", "spm"}
