"""Conversation repair against whole-string DP, in one and in many segments."""

import itertools
import random

import pytest

from revlens.llm import conversation_repair as cr


def _check(spark, rows, **how):
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, live boolean, audit string, cost int")
    got = sorted((tuple(r) for r in cr.digest(cr.repair(d, live_col="live", **how)).select(
        "conv_id", *cr._FACTS, "audit", "repaired_sha256").collect()), key=str)
    assert got == sorted(cr.brute_force(rows), key=str)
    return got


def _rows(rng, convs, longest):
    out = []
    for c in convs:
        for t in range(rng.randint(1, longest)):
            out.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]),
                        rng.choice(["Hi.", "What?", "cut off", "", " \n", None, f"t{t}.", f"t{t}", "end!  ", "日本。"]), rng.random() > 0.1))
    rng.shuffle(out)
    return out


def test_solve_is_the_cheapest_and_first_of_all_edits():
    rows = [(i, c) for i in "sux" for c in (0, cr.MUST_GO, cr.TRUNCATED)]
    for n in range(4):
        for some in itertools.product(rows, repeat=n):
            facts = [(1, k, {"s": "system", "u": "user", "x": "xyz"}[i], f"{j}" if c & cr.TRUNCATED else "" if c else f"{j}.", True)
                     for j, (i, c) in enumerate(some) for k in [j]]
            if facts:
                want = cr.brute_force(facts)[0]
                assert cr.solve(list(some), cr.Audits()) == (want[6], want[7])


def test_brute_force_by_enumeration():
    """All edit strings up to two inserts at a place, without any DP."""
    rng = random.Random(2)
    for _ in range(60):
        rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice([f"a{t}.", "same.", "", f"b{t}"]), True) for t in range(rng.randint(0, 3))]
        best = None
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            for edits in itertools.product("KRD", repeat=len(rows)):
                audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
                state, cost, it, ok, seen = "", 0, iter(rows), True, set()
                for e in audit:
                    if e == "I":
                        state, cost = "a" if state == "u" else "u", cost + 2
                        continue
                    role, text = next(it)[2:4]
                    bad = not text.strip() or (role, text) in seen
                    seen.add((role, text))
                    more = int(not bad and text[-1] not in ".!?")
                    if e == "D":
                        cost += 3
                    elif bad or (e == "K" and role[0] != ("a" if state == "u" else "u") and not (role[0] == "s" and state == "")):
                        ok = False
                    else:
                        state, cost = (role[0] if e == "K" else "a" if state == "u" else "u"), cost + more + 2 * (e == "R")
                if ok and state in ("", "a"):
                    best = min(best or (cost, audit), (cost, audit))
        want = cr.brute_force(rows)
        assert (want[0][6:8] if want else (0, "")) == best


def test_audits_compare_as_strings():
    rng, audits, nodes = random.Random(4), cr.Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-20:]), rng.choice("DIK")))
    for a in nodes:
        for b in rng.sample(nodes, 20):
            assert audits.less(a, b) == (audits.text(a) < audits.text(b))
    assert [audits.text(n) for n in audits.order(nodes)] == sorted(map(audits.text, nodes))


def test_equal_hashes_prove_nothing(monkeypatch):
    monkeypatch.setattr(cr.Audits, "PRIME", 1)      # every hash is 0
    test_audits_compare_as_strings()
    rng = random.Random(8)
    for _ in range(50):
        rows = [(rng.choice("sua"), rng.choice([0, 0, 1, 2])) for _ in range(12)]
        with pytest.MonkeyPatch.context() as m:
            m.setattr(cr.Audits, "PRIME", (1 << 61) - 1)
            want = cr.solve(rows, cr.Audits())
        assert cr.solve(rows, cr.Audits()) == want


def test_segments_give_the_whole():
    rng = random.Random(6)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 30))]
        cost, audit = cr.solve(rows, cr.Audits())
        cuts = sorted(rng.sample(range(len(rows) + 1), rng.randint(0, min(4, len(rows)))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]     # empty ones too
        tables = [cr.segment_table(p, cr.Audits()) for p in parts]
        got, path = cr.best_path([t[:2] for t in tables])
        text = "".join(t[2][4 * i + j] for t, (i, j) in zip(tables, path)) + cr.TAIL[path[-1][1]]
        assert (got, text) == (cost, audit)


@pytest.mark.parametrize("how", [{}, {"segment": 3}, {"segment_bytes": 12}])
def test_tables_of_conversations(spark, how):
    rng = random.Random(len(str(how)))
    rows = _rows(rng, [None, *range(60)], 12) + _rows(rng, [100], 400) + [(200, t, "user", "x.", False) for t in range(3)]
    got = {r[0]: r for r in _check(spark, rows, **how)}
    assert got[200][1:8] == (0, 0, 0, 0, 0, 0, "") and len(got) == 63


def test_one_conversation_in_many_slices(spark):
    rng = random.Random(12)
    rows = [(7, t if rng.random() < 0.9 else t // 2, rng.choice(["user", "assistant", "assistant", "system"]),
             rng.choice([f"t{t}.", f"t{t}", "same.", ""]), rng.random() > 0.05) for t in range(1500)]
    blocks = cr.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, live boolean"), live_col="live", segment=50)
    assert blocks.where("not whole").count() > 25       # spread over segments, in all slices
    _check(spark, rows, segment=50)


def test_damage_and_rows(spark):
    import zlib

    rows = [(c, t, r, x) for c, t, r, x in [(c, t, "assistant" if t % 2 else "user", f"Text {t}. More!") for c in range(30) for t in range(8)]]
    rows += [(None, None, None, None), (5, None, "user", None)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind in (0, 1) else x.replace(".", "").replace("!", "") if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x, kind != 0)] * (2 if kind == 3 else 1)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in cr.damage(d).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    blocks = cr.repair(cr.damage(d), live_col="live", segment=4)
    made = {}
    for r in sorted(cr.repaired_rows(blocks).collect(), key=lambda r: (str(r["conv_id"]), r["segment"], r["place"])):
        made.setdefault(r["conv_id"], []).append(r["role"][0])
    import re

    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in made.values()) and len(made) == 30


def test_empty_and_long_texts(spark):
    d = spark.createDataFrame([(1, 0, "user", "a" * 3_000_000 + "."), (1, 1, "assistant", "b" * 5_000_000 + "!")],
                              "conv_id long, turn long, role string, text string")
    r = cr.digest(cr.repair(d)).collect()
    assert [(x["conv_id"], x["audit"], x["cost"]) for x in r] == [(1, "KK", 0)]
    assert cr.digest(cr.repair(cr.damage(d.where("false")), live_col="live")).collect() == []
