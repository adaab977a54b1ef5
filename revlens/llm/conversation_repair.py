"""Operator 12: conversation structure repair by a persistent audit DP.

A conversation is a row of turns that should read, by the initials of its
roles, ``(s?(ua)+)?``.  Each row's first fault counts: blank (no character but
ASCII blanks), duplicate (role and text seen earlier), truncated (its last such
character ends no sentence).  Edits: K keeps a row, R gives it the role user or
assistant, D deletes it (blanks and duplicates must go), I inserts an empty
user or assistant row; K is free, I and R cost 2, D costs 3, a truncated row
that stays costs 1 more.  The repair is the cheapest row of edits, and of
equally cheap ones the least as an ASCII string (the audit).

The DP has four states (nothing, system, user or assistant last).  Its edit
prefixes are shared: an audit is a node that links to its prefix and holds the
rolling hash of the whole string and binary-lifting ancestors.  Two prefixes of
equal cost are compared by their longest common prefix, found by lifting both
while the hashes differ; equal hashes count only if the nodes are the same or
their characters prove it.

Scale: rows are range-partitioned by (conversation, turn) and sorted.  A
conversation that lies inside one slice and is not too long is repaired there.
One that crosses a slice, or has more than ``SEGMENT`` rows, is cut into
segments.  A segment gives the cost of each state from each state and the order
of its audits: before a row, prefixes end with an edit of the row before, so no
one is the beginning of another, and across segments the order of two prefixes
is all that a tie needs.  A path over these tables (16 costs a segment) picks
the states at the bounds, and each segment then takes the audit of its pair of
states.  So a conversation with a third of all rows is spread over many tasks;
only the path, some 200 bytes for ``SEGMENT`` rows, runs in one.

Cases: NULL roles and texts are one space (a role without a fitting initial,
a blank text); NULL turns come first and count in no gap; rows of one turn are
ordered by role and text; a NULL conv_id is a conversation; a conversation
without rows (all dropped) has zeros and an empty audit; very long texts are
held one segment at a time; empty tables give empty results; other columns,
clashing names included, are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.llm.components import written
from revlens.plans.session import shuffle_partitions

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SEGMENT = 4096
SEGMENT_BYTES = 4 << 20
#: Parts of the row code: must go, truncated.
MUST_GO, TRUNCATED = 1, 2

_BLANKS = " \t\n\x0b\x0c\r"


class Audits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    BASE, PRIME = 911_382_323, (1 << 61) - 1

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]     # up[node][k]: 2**k edits shorter

    def add(self, node: int, edit: str) -> int:
        up = [node]
        while len(self.up[up[-1]]) >= len(up):
            up.append(self.up[up[-1]][len(up) - 1])
        self.up.append(up)
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.BASE + ord(edit)) % self.PRIME)
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        left, k = self.depth[node] - depth, 0
        while left:
            if left & 1:
                node = self.up[node][k]
            left, k = left >> 1, k + 1
        return node

    def same(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell the same string."""
        if x == y:
            return True
        if self.hash[x] != self.hash[y]:
            return False
        while x != y:       # equal hashes prove nothing
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a is before that of b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if not self.same(p, q):
                    x, y = p, q
        return self.edit[x] < self.edit[y]      # the first edits that differ

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def order(self, nodes: Sequence[int]) -> list[int]:
        return sorted(nodes, key=functools.cmp_to_key(lambda a, b: 0 if a == b else -1 if self.less(a, b) else 1))


def transfer(rows: Sequence[tuple[str, int]], start: int, audits: Audits) -> list[tuple[int, int] | None]:
    """(cost, audit node) of each state after the rows (initial, code), from
    one state before them; inserts are made before rows only."""
    best: list[tuple[int, int] | None] = [None] * 4
    best[start] = (0, 0)

    def offer(to: list, state: int, of: tuple[int, int] | None, edit: str, cost: int) -> None:
        if of is None:
            return
        cost += of[0]
        have = to[state]
        if have is None or cost < have[0]:
            to[state] = (cost, audits.add(of[1], edit))
        elif cost == have[0]:
            node = audits.add(of[1], edit)
            if audits.less(node, have[1]):
                to[state] = (cost, node)

    for initial, code in rows:
        for state in (NOTHING, SYSTEM, ASSISTANT):
            offer(best, USER, best[state], INSERT, COST[INSERT])
        offer(best, ASSISTANT, best[USER], INSERT, COST[INSERT])
        after: list[tuple[int, int] | None] = [None] * 4
        for state in range(4):
            offer(after, state, best[state], DELETE, COST[DELETE])
        if not code & MUST_GO:
            more = TRUNCATED_COST if code & TRUNCATED else 0
            if initial == "s":
                offer(after, SYSTEM, best[NOTHING], KEEP, COST[KEEP] + more)
            edit = KEEP if initial == "u" else REROLE
            for state in (NOTHING, SYSTEM, ASSISTANT):
                offer(after, USER, best[state], edit, COST[edit] + more)
            edit = KEEP if initial == "a" else REROLE
            offer(after, ASSISTANT, best[USER], edit, COST[edit] + more)
        best = after
    return best


#: Inserts after the last row that end a conversation in a state.
TAIL = {NOTHING: "", ASSISTANT: "", USER: INSERT, SYSTEM: INSERT * 2}


def solve(rows: Sequence[tuple[str, int]], audits: Audits) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    audits.clear()
    ends = transfer(rows, NOTHING, audits)
    total = {s: ends[s][0] + COST[INSERT] * len(TAIL[s]) for s in range(4) if ends[s]}
    least = min(total.values())
    node, state = 0, NOTHING
    for s in (s for s in total if total[s] == least):
        if not node or audits.less(ends[s][1], node):
            node, state = ends[s][1], s
    return least, audits.text(node) + TAIL[state]


def segment_table(rows: Sequence[tuple[str, int]], audits: Audits) -> tuple[list, list, list]:
    """Costs, ranks among the audits of one start, and audits, each of 16
    (start, end) pairs; None where no edits lead from start to end."""
    costs: list = [None] * 16
    ranks: list = [None] * 16
    texts: list = [None] * 16
    for start in range(4):
        audits.clear()
        ends = transfer(rows, start, audits)
        place = {n: r for r, n in enumerate(audits.order([e[1] for e in ends if e]))}
        for end, e in enumerate(ends):
            if e:
                at = 4 * start + end
                costs[at], ranks[at], texts[at] = e[0], place[e[1]], audits.text(e[1])
    return costs, ranks, texts


def best_path(tables: Sequence[tuple[Sequence, Sequence]]) -> tuple[int, list[tuple[int, int]]]:
    """(cost, (start, end) of each segment) of a conversation's segments."""
    now = {NOTHING: (0, 0)}
    came: list[dict[int, int]] = []
    for costs, ranks in tables:
        found: dict[int, tuple] = {}
        for end in range(4):
            options = [(now[s][0] + costs[4 * s + end], (now[s][1], ranks[4 * s + end]), s) for s in now if costs[4 * s + end] is not None]
            if options:
                found[end] = min(options)
        order = {o: r for r, o in enumerate(sorted({f[1] for f in found.values()}))}
        came.append({end: f[2] for end, f in found.items()})
        now = {end: (f[0], order[f[1]]) for end, f in found.items()}
    cost, _, state = min((c + COST[INSERT] * len(TAIL[s]), r, s) for s, (c, r) in now.items())
    path = []
    for back in reversed(came):
        path.append((back[state], state))
        state = back[state]
    return cost, path[::-1]


def apply_audit(audit: str, state: int, rows: Sequence[tuple[str, str]]) -> list[dict]:
    """The repaired (role, text) rows of an audit that begins in a state."""
    out, it = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(it)
        if edit == DELETE:
            continue
        if edit == KEEP:
            state = STATE_OF[role[0]]
        else:
            state = ASSISTANT if state == USER else USER
            role = ROLE_OF[state]
        out.append({"role": role, "text": text})
    return out


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, live): faults made by crc32 of the ids.  A
    dropped row stays as a row that is not live, so its conversation is known."""
    d = conversations
    blank = F.lit(" ")
    conv, turn = d[conv_col], d[turn_col]
    kind = F.crc32(F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    role, text = F.coalesce(d[role_col], blank), F.coalesce(d[text_col], blank)
    return (d.select(conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
                     F.when(kind.isin(0, 1), F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
                     (kind != 0).alias("live"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))
            .select("conv_id", "turn", "role", "text", "live", F.explode(F.sequence(F.lit(1), "times")).alias("time")).drop("time", "times"))


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, live: Column) -> DataFrame:
    """The narrow facts of each row beside its text, in slices by range."""
    role, text = F.coalesce(rows[role_col], F.lit(" ")), F.coalesce(rows[text_col], F.lit(" "))
    flat = rows.select(rows[conv_col].alias("conv_id"), rows[turn_col].cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
                       live.alias("live"))
    ends = F.rtrim("text", F.lit(_BLANKS))
    code = F.when(ends == "", MUST_GO).when(F.right(ends, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    flat = flat.withColumns({"code": code.cast("int"), "head": F.substring("text", 1, 64),
                             "key": F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))})
    by = ["conv_id", "turn", "role", "head", "key"]
    return (flat.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by).drop("head")
            .withColumn("pos", F.monotonically_increasing_id()))


_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Facts:
    """The counts of consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first = self.last = None

    def row(self, turn: int | None, initial: str, code: int, again: bool) -> int:
        """Counts a row and returns its code as the DP sees it."""
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None:
            if self.last_turn is None or turn != self.last_turn:
                self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.low = turn if self.low is None else min(self.low, turn)
            self.high = turn if self.high is None else max(self.high, turn)
            self.last_turn = turn
        if code & MUST_GO:
            self.blank += 1
        elif again:
            self.duplicate += 1
            return MUST_GO
        elif code & TRUNCATED:
            self.truncated += 1
        return code

    def join(self, o: "_Facts") -> None:
        """Adds the facts of the rows that follow."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(o, name))
        if self.last is not None and o.first is not None:
            self.illegal += self.last + o.first not in LEGAL
        self.first, self.last = (self.first if self.first is not None else o.first), (o.last if o.last is not None else self.last)
        if o.low is not None:
            self.turns -= self.last_turn == o.first_turn
            self.low = o.low if self.low is None else min(self.low, o.low)
            self.high = o.high if self.high is None else max(self.high, o.high)
            self.last_turn = o.last_turn

    def totals(self, cost: int) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip(_FACTS, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)))


def _flat_rows(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            yield from zip(*[part.column(part.schema.get_field_index(n)).to_pylist() for n in names])


_REPAIRED = "repaired array<struct<role:string,text:string>>"
_TOTALS = ", ".join(f"{n} bigint" for n in _FACTS)


def _slices(out_schema: pa.Schema, segment: int, segment_bytes: int):
    """Repairs the conversations that lie inside a slice; the rows of the
    others (the first and the last one, and long ones) pass, with the segment
    each belongs to."""
    names = ("conv_id", "turn", "role", "text", "live", "code", "key", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audits, out, held, size = Audits(), [], [], 0
        state = {"seg": None, "rows": 0, "bytes": 0}

        def passed(r: tuple) -> None:
            n = len(r[3])
            if state["seg"] is None or state["rows"] >= segment or state["bytes"] + n > segment_bytes:
                state.update(seg=r[7], rows=0, bytes=0)
            state["rows"] += 1
            state["bytes"] += n
            out.append(dict(zip(names, r)) | {"whole": False, "segment": state["seg"]})

        def repaired() -> dict:
            facts, seen, rows, texts = _Facts(), set(), [], []
            for _, turn, role, text, live, code, key, _ in held:
                if live:
                    rows.append((role[:1], facts.row(turn, role[:1], code, key in seen)))
                    seen.add(key)
                    texts.append((role, text))
            cost, audit = solve(rows, audits)
            return {"conv_id": held[0][0], "whole": True, "segment": held[0][7], "audit": audit,
                    "repaired": apply_audit(audit, NOTHING, texts)} | facts.totals(cost)

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) > least:
                yield pa.RecordBatch.from_pylist(out, schema=out_schema)
                out.clear()

        conv, begun, inside = None, False, False
        for r in _flat_rows(batches, names):
            if not begun or r[0] != conv:
                if held and inside:
                    out.append(repaired())
                held.clear()
                inside, begun, conv, size = begun, True, r[0], 0    # the first one may have begun before
            if inside and (len(held) >= segment or size > segment_bytes):
                inside = False
                for h in held:
                    passed(h)
                held.clear()
            if inside:
                held.append(r)
                size += len(r[3])
            else:
                passed(r)
            yield from ready(500)
        for h in held:      # the last one may go on
            passed(h)
        yield from ready(0)

    return run


def _pieces(schema: pa.Schema):
    """The tables of the conversations of a segment."""

    def run(rows: pa.Table, again: pa.Table) -> pa.Table:
        dup = set(again.column("again").to_pylist())
        audits, out = Audits(), []
        pieces: list[tuple] = []
        for r in sorted(rows.to_pylist(), key=lambda r: r["pos"]):
            if not pieces or pieces[-1][0] != r["conv_id"]:
                pieces.append((r["conv_id"], r["segment"], _Facts(), []))
            if r["live"]:
                facts, codes = pieces[-1][2:]
                codes.append((r["initial"], facts.row(r["turn"], r["initial"], r["code"], r["pos"] in dup)))
        for conv, seg, facts, codes in pieces:
            costs, ranks, texts = segment_table(codes, audits)
            out.append(vars(facts) | {"conv_id": conv, "segment": seg, "costs": costs, "ranks": ranks, "audits": texts})
        return pa.Table.from_pylist(out, schema=schema)

    return run


_PIECE_FACTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first_turn", "last_turn", "first", "last")


def _paths(schema: pa.Schema):
    """The states at the bounds of the segments of each conversation; the
    pieces come sorted by conversation and segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            facts = _Facts()
            for h in held:
                vars(o := _Facts()).update(zip(_PIECE_FACTS, h[4:]))
                facts.join(o)
            cost, path = best_path([(h[2], h[3]) for h in held])
            totals = facts.totals(cost)
            rows = [{"conv_id": h[0], "segment": h[1], "start": p[0], "pair": 4 * p[0] + p[1] + 1,
                     "tail": TAIL[p[1]] if h is held[-1] else ""} | totals for h, p in zip(held, path)]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for r in _flat_rows(batches, ("conv_id", "segment", "costs", "ranks", *_PIECE_FACTS)):
            if held and held[-1][0] != r[0]:
                yield done()
                held.clear()
            held.append(r)
        if held:
            yield done()

    return run


def _applied(schema: pa.Schema):
    """The repaired rows of the conversations of a segment."""

    def run(rows: pa.Table, chosen: pa.Table) -> pa.Table:
        texts: dict = {}
        for r in sorted(rows.to_pylist(), key=lambda r: r["pos"]):
            at = texts.setdefault(r["conv_id"], [])
            if r["live"]:
                at.append((r["role"], r["text"]))
        out = [c | {"conv_id": c["of"], "segment": c["of_segment"], "whole": False,
                    "repaired": apply_audit(c["audit"], c["start"], texts[c["of"]])} for c in chosen.to_pylist()]
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           live_col: str | None = None, segment: int = SEGMENT, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Blocks of repaired conversations: conv_id, whole (the only block),
    segment (order of blocks), audit and repaired rows of the block, and the
    counts and cost of the conversation, repeated in each of its blocks."""
    live = F.lit(True) if live_col is None else rows[live_col]
    kind = rows.schema[conv_col].dataType.simpleString()
    ids = f"conv_id {kind}, segment bigint"
    passed = "turn bigint, role string, text string, live boolean, code int, key binary, pos bigint"
    block = f"{ids}, whole boolean, audit string, {_REPAIRED}, {_TOTALS}"
    columns = [f.name for f in T.StructType.fromDDL(block)]
    ddl = f"{block}, {passed}"
    sliced = written(_ordered(rows, conv_col, turn_col, role_col, text_col, live)
                     .mapInArrow(_slices(_arrow(ddl), segment, segment_bytes), ddl), "repair-slices")
    whole, parts = sliced.where("whole").select(*columns), sliced.where("not whole")

    told = parts.where(f"live and code <> {MUST_GO}").select("conv_id", "segment", "key", "pos")
    first = (told.groupBy(F.col("conv_id").alias("of"), F.col("key").alias("of_key")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
             .where("n > 1"))
    again = (told.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
             .where("pos > first").select(F.col("segment").alias("of_segment"), F.col("pos").alias("again")))
    narrow = parts.select("conv_id", "segment", "turn", F.substring("role", 1, 1).alias("initial"), "live", "code", "pos")
    piece = (f"{ids}, costs array<bigint>, ranks array<int>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, "
             "illegal bigint, turns bigint, low bigint, high bigint, first_turn bigint, last_turn bigint, first string, last string")
    pieces = written(narrow.groupBy("segment").cogroup(again.groupBy("of_segment")).applyInArrow(_pieces(_arrow(piece)), piece), "repair-pieces")
    path = f"{ids}, start int, pair int, tail string, {_TOTALS}"
    paths = (pieces.drop("audits").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
             .mapInArrow(_paths(_arrow(path)), path).withColumnsRenamed({"conv_id": "of", "segment": "of_segment"}))
    chosen = (pieces.select("conv_id", "segment", "audits")
              .join(paths, (F.col("segment") == F.col("of_segment")) & F.col("conv_id").eqNullSafe(F.col("of")))
              .select(F.col("conv_id").alias("of"), F.col("segment").alias("of_segment"), "start", F.concat(F.element_at("audits", F.col("pair")), "tail").alias("audit"), *_FACTS))
    blocks = (parts.select("conv_id", "segment", "role", "text", "live", "pos").groupBy("segment").cogroup(chosen.groupBy("of_segment"))
              .applyInArrow(_applied(_arrow(block)), block))
    return whole.unionByName(blocks)


def _joined(schema: pa.Schema):
    """Audit and hash of conversations whose blocks come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, audit, totals, lines = None, None, [], (), 0

        def done() -> pa.RecordBatch:
            row = dict(zip(_FACTS, totals)) | {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for r in _flat_rows(batches, ("conv_id", "audit", "repaired", *_FACTS)):
            if sha is None or r[0] != conv:
                if sha is not None:
                    yield done()
                conv, sha, audit, totals, lines = r[0], hashlib.sha256(), [], r[3:], 0
            audit.append(r[1])
            for x in r[2]:
                sha.update(f"{'' if not lines else chr(10)}{x['role']}:{x['text']}".encode())
                lines += 1
        if sha is not None:
            yield done()

    return run


def digest(blocks: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost, audit, repaired_sha256."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, {_TOTALS}, audit string, repaired_sha256 string"
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    whole = blocks.where("whole").select("conv_id", *_FACTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = (blocks.where("not whole").select("conv_id", "segment", "audit", "repaired", *_FACTS)
             .repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_joined(_arrow(ddl)), ddl))
    return whole.unionByName(parts)


def repaired_rows(blocks: DataFrame) -> DataFrame:
    """(conv_id, segment, place, role, text): the repaired conversations as
    rows, ordered by segment and place."""
    return blocks.select("conv_id", "segment", F.posexplode("repaired").alias("place", "row")).select("conv_id", "segment", "place", "row.*")


def brute_force(rows: Sequence[tuple]) -> list[tuple]:
    """The digest of (conv_id, turn, role, text, live) rows by whole strings."""
    import re

    convs: dict = {}
    for conv, turn, role, text, live in rows:
        got = convs.setdefault(conv, [])
        if live:
            got.append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in got:
            kinds.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in seen
                         else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in got if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(got, got[1:]))
        best = {"": (0, "")}

        def inserted(at: dict) -> dict:
            at = dict(at)
            for _ in range(2):
                for s, (c, e) in list(at.items()):
                    to = "a" if s == "u" else "u"
                    at[to] = min(at.get(to, (c + 2, e + "I")), (c + 2, e + "I"))
            return at

        for (_, role, _), kind in zip(got, kinds):
            options: dict = {}
            for s, (c, e) in inserted(best).items():
                options.setdefault(s, []).append((c + 3, e + "D"))
                if kind in ("blank", "duplicate"):
                    continue
                more, fit = int(kind == "truncated"), "a" if s == "u" else "u"
                if role[:1] == fit or (s == "" and role[:1] == "s"):
                    options.setdefault(role[:1], []).append((c + more, e + "K"))
                options.setdefault(fit, []).append((c + 2 + more, e + "R"))
            best = {s: min(o) for s, o in options.items()}
        cost, audit = min(v for s, v in inserted(best).items() if s in ("", "a"))
        lines, state, left = [], "", list(got)
        for e in audit:
            role, text = ("", "") if e == "I" else left.pop(0)[1:]
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        out.append((conv, gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out
