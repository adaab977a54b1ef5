"""Next-fit packing of ordered files as one bounded distributed pass.

Next-fit is a sequential fold: a file joins the open chunk while it fits,
else it opens the next one; an oversized file closes the chunk and becomes
chunks of its own.  A project may hold a third of all files, so the fold is
cut into slices of a range partitioning by (project, order):

1. a slice that begins inside a project does not know how full the open chunk
   is.  But the fill decides only which file is the first not to fit, and from
   there on the chunks do not depend on it.  So a slice has a small table: for
   each range of fills, the chunks begun and the fill at its end.  Paths from
   different files soon meet, each is followed only until then;
2. the tables of a project are applied one after the other (a few numbers per
   slice), which gives the state at the entry of every slice;
3. each slice is packed from its entry state.

Only the first project of a slice can come from an earlier one, so there are
no more entry states than slices: a proven bound for the broadcast.  Steps 1
and 3 read one exchange, which Spark reuses.  No job runs while a DataFrame is
built.  Several budgets are packed in one pass of step 1 (``chunk_counts``).

Chunk starts are found by bisection of prefix sums: the work in Python is a
step per chunk, not per file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.plans.session import ensure_checkpoint_dir, shuffle_partitions

#: Chunks begun, tokens and members of the open chunk.  No open chunk: 0, 0.
State = tuple[int, int, int]
CLOSED: State = (0, 0, 0)


class Slice:
    """Consecutive files of one project under one budget."""

    def __init__(self, tokens: np.ndarray, parts: np.ndarray, budget: int):
        self.n, self.budget = len(tokens), budget
        self.over = tokens > budget
        self.tokens, self.parts = tokens, np.where(self.over, parts, 0)
        self.upto = np.cumsum(np.where(self.over, 0, tokens))
        self.overs = np.flatnonzero(self.over)
        self.parts_upto = np.concatenate([[0], np.cumsum(self.parts)])

    def _next_over(self, i: int) -> int:
        at = int(np.searchsorted(self.overs, i))
        return int(self.overs[at]) if at < len(self.overs) else self.n

    def _first_not_to_fit(self, i: int, room: int) -> int:
        """The first small file from i on that exceeds the room."""
        before = int(self.upto[i - 1]) if i else 0
        return int(np.searchsorted(self.upto, before + room, side="right"))

    def _after(self, i: int, room: int) -> tuple[int, int, int | None]:
        """From file i with that room in the open chunk: (chunks that
        oversized files add, first file of the next chunk, or n; where the
        chunk was closed by an oversized file, else None)."""
        j, k = self._next_over(i), self._first_not_to_fit(i, room)
        if k < j:
            return 0, k, None
        if j == self.n:
            return 0, self.n, None
        m = j
        while m < self.n and self.over[m]:
            m += 1
        return int(self.parts_upto[m] - self.parts_upto[j]), m, j

    def follow(self, i: int, memo: dict[int, State]) -> State:
        """Chunks begun at file i and later, and the open chunk at the end."""
        path = []
        while i < self.n and i not in memo:
            added, nxt, closed = self._after(i, self.budget)
            path.append((i, added, nxt, closed))
            i = nxt
        if i < self.n:
            state = memo[i]
        elif not path:
            state = CLOSED
        else:
            at, added, _, closed = path[-1]
            if closed is not None:
                state = (0, 0, 0)
            else:
                state = (0, int(self.upto[-1]) - (int(self.upto[at - 1]) if at else 0), self.n - at)
        for at, added, _, _ in reversed(path):
            state = (state[0] + 1 + added, state[1], state[2])
            memo[at] = state
        return state

    def leave(self, entry: State, memo: dict[int, State] | None = None) -> State:
        """The state after the slice."""
        if not self.n:
            return entry
        begun, fill, members = entry
        memo = {} if memo is None else memo
        i, added = 0, 0
        if fill:
            added, i, closed = self._after(0, self.budget - fill)
            if i == self.n:
                return (begun + added, 0, 0) if closed is not None else (begun, fill + int(self.upto[-1]), members + self.n)
        elif self.over[0]:
            added, i, _ = self._after(0, self.budget)
        end = self.follow(i, memo)
        return begun + added + end[0], end[1], end[2]

    def table(self) -> list[tuple[int, int, int, int, bool]]:
        """Rows (least fill, chunks, fill, members, open) by falling fill: an
        entry takes the first row whose least fill it reaches; with ``open``
        its chunk is still open at the end, and fill and members add to it."""
        memo: dict[int, State] = {}
        rows: list[tuple[int, int, int, int, bool]] = []
        fill = self.budget
        while fill > 0:
            added, i, closed = self._after(0, self.budget - fill)
            still = i == self.n and closed is None
            end = (0, int(self.upto[-1]) if self.n else 0, self.n) if still else self.follow(i, memo)
            # the least fill with this first file: the files before it, and it, do not fit
            low = 1 if still or closed is not None else self.budget - int(self.upto[i]) + 1
            row = (max(low, 1), added + end[0], end[1], end[2], still)
            if rows and rows[-1][1:] == row[1:]:
                rows[-1] = row
            else:
                rows.append(row)
            fill = row[0] - 1
        return rows

    def place(self, entry: State) -> tuple[np.ndarray, np.ndarray]:
        """(chunk, place in the chunk) of each file; an oversized file has the
        number of its first chunk."""
        begins = np.zeros(self.n, dtype=np.int64)
        i = 0
        if self.n and entry[1]:
            _, i, _ = self._after(0, self.budget - entry[1])
        elif self.n and self.over[0]:
            _, i, _ = self._after(0, self.budget)
        while i < self.n:
            begins[i] = 1
            _, i, _ = self._after(i, self.budget)
        chunk = entry[0] + np.cumsum(begins + self.parts)
        index = np.arange(self.n)
        since = np.maximum.accumulate(np.where(begins == 1, index, -1))
        place = np.where(since < 0, entry[2] + index, index - since)
        return np.where(self.over, chunk - self.parts + 1, chunk), np.where(self.over, 0, place)


def apply_table(rows: Sequence[Sequence], entry: State) -> State:
    """The state after a slice, from its table; no open chunk is as good as
    a full one."""
    begun, fill, members = entry
    for low, chunks, end, more, still in rows:
        if (fill or 1 << 62) >= low:
            return (begun, fill + end, members + more) if still else (begun + chunks, end, more)
    raise ValueError("a table covers all fills")


_FILES = "project string, relative string, lkey string, size bigint, lines bigint, tokens bigint, chars bigint"


def narrow_files(files: DataFrame) -> DataFrame:
    """The numbers of each file; ``project`` is a key that is never NULL."""
    return files.select(F.coalesce(F.concat(F.lit("="), F.col("project")), F.lit("")).alias("project"), "relative",
                        F.lower(F.col("relative")).alias("lkey"), F.col("size").cast("bigint").alias("size"),
                        F.col("lines").cast("bigint").alias("lines"), F.col("tokens").cast("bigint").alias("tokens"),
                        F.length("text").cast("bigint").alias("chars"))


def _sliced(narrow: DataFrame, n: int | None) -> DataFrame:
    spark = narrow.sparkSession
    order = ["project", "lkey", "relative"]
    out = (narrow.repartitionByRange(n or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
           .withColumn("slice", F.spark_partition_id()))
    if spark.conf.get("spark.sql.exchange.reuse", "true") != "true":
        ensure_checkpoint_dir(spark)      # the bounds are sampled: read the slices once
        out = out.checkpoint(eager=True)
    return out


def _projects(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.Table]]:
    """(number, project, its rows) of the sorted rows of a slice."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    key = table.column("project").combine_chunks()
    new = np.flatnonzero(np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]))
    for k, (lo, hi) in enumerate(zip(new, [*new[1:], len(key)])):
        yield k, key[int(lo)].as_py(), table.slice(int(lo), int(hi - lo))


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _part_counts(t: pa.Table, width: int) -> np.ndarray:
    return -(-_numbers(t, "chars") // width)


_TABLE = ("slice int, project string, budget bigint, first boolean, begun bigint, fill bigint, members bigint, "
          "low array<bigint>, chunks array<bigint>, ends array<bigint>, more array<bigint>, still array<boolean>")


def _tables(budgets: Sequence[tuple[int, int]], every: bool):
    """Step 1.  The first project of a slice has a table, another one the
    state at its end, needed of the last one (or, with ``every``, of all)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_TABLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for k, project, t in _projects(batches):
            if not every and k > 1:
                out = out[:-len(budgets)]     # neither first nor last
            for budget, width in budgets:
                s = Slice(_numbers(t, "tokens"), _part_counts(t, width), budget)
                row = {"slice": int(_numbers(t, "slice")[0]), "project": project, "budget": budget, "first": k == 0}
                if k == 0:
                    row |= dict(zip(("low", "chunks", "ends", "more", "still"), map(list, zip(*s.table()))))
                else:
                    row |= dict(zip(("begun", "fill", "members"), s.leave(CLOSED)))
                out.append(row)
            if every and len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


_ENTRY = "slice int, project string, budget bigint, begun bigint, fill bigint, members bigint, after_begun bigint"


def _chain():
    """Step 2.  Rows come by (project, budget, slice)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(_ENTRY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, CLOSED
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["project"], r["budget"]) != key:
                    key, state = (r["project"], r["budget"]), CLOSED
                entry = state
                if r["first"]:
                    state = apply_table(list(zip(r["low"], r["chunks"], r["ends"], r["more"], r["still"])), state)
                else:
                    state = (r["begun"], r["fill"], r["members"])
                out.append({"slice": r["slice"], "project": r["project"], "budget": r["budget"], "after_begun": state[0]}
                           | dict(zip(("begun", "fill", "members"), entry)))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _chained(sliced: DataFrame, budgets: Sequence[tuple[int, int]], every: bool) -> DataFrame:
    tables = sliced.mapInArrow(_tables(budgets, every), _TABLE)
    by = ["project", "budget"]
    return tables.repartition(*by).sortWithinPartitions(*by, "slice").mapInArrow(_chain(), _ENTRY)


def _placer(budget: int, width: int):
    """Step 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, _, t in _projects(batches):
            entry = CLOSED
            if k == 0 and t.column("begun")[0].is_valid:
                entry = tuple(int(t.column(c)[0].as_py()) for c in ("begun", "fill", "members"))
            s = Slice(_numbers(t, "tokens"), _part_counts(t, width), budget)
            chunk, place = s.place(entry)
            kept = t.select(["project", "relative", "size", "lines", "tokens", "chars"])
            for name, values in (("over", pa.array(s.over)), ("chunk_id", pa.array(chunk, pa.int64())), ("pos", pa.array(place, pa.int32()))):
                kept = kept.append_column(name, values)
            yield from kept.to_batches(max_chunksize=10_000)

    return run


def place_files(narrow: DataFrame, budget: int, width: int, num_partitions: int | None = None) -> DataFrame:
    """Each file with ``over``, its chunk (an oversized file: the first of its
    chunks) and its place in the chunk."""
    sliced = _sliced(narrow, num_partitions)
    entries = _chained(sliced, [(budget, width)], every=False)
    entry = entries.where("begun + fill > 0").select(F.col("slice").alias("at"), F.col("project").alias("of"), "begun", "fill", "members")
    rows = sliced.join(F.broadcast(entry), (F.col("slice") == F.col("at")) & (F.col("project") == F.col("of")), "left").drop("at", "of")
    return rows.mapInArrow(_placer(budget, width), "project string, relative string, size bigint, lines bigint, tokens bigint, chars bigint, "
                                                   "over boolean, chunk_id bigint, pos int")


def chunk_counts(files: DataFrame, budgets: Sequence[tuple[int, int]], num_partitions: int | None = None) -> DataFrame:
    """(project, budget, chunks) for a set of (budget, part width) in one pass
    over the ordered files."""
    last = _chained(_sliced(narrow_files(files), num_partitions), list(budgets), every=True)
    return (last.groupBy("project", "budget").agg(F.max("after_begun").alias("chunks"))
            .withColumn("project", F.when(F.col("project") != "", F.substring("project", 2, (1 << 31) - 1))))
