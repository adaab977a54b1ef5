"""Operator 13: mixing sources to target weights by systematic sampling.

Sources in order of their code points (NULL last) get the given weights in
turn.  Their targets share the words of all documents by weight; a target
stops at ``MOST_COPIES`` times the words of its source, and what it leaves is
shared by weight among the others until none is above.  That is one level:
target = min(weight x level, most copies x words), found by running sums over
the sources in the order in which they reach their bound.

Within a source the documents are ordered by size and, among equal sizes, by
a seeded hash of the id.  Each document's expected copies (target / words of
the source, in units of 2**-24) are prefix-summed, one random offset for the
source is added, and a document is taken once for each whole number that its
piece of the sum crosses.  In that order the words taken from a source differ
from its target by about one of its largest documents at most, and no document
is taken more than ``MOST_COPIES`` times.

The order and the offsets come from hashes of a seed: a rerun takes the same
documents.  The sums run over slices of a range partitioning
(``plans.prefix``), of documents and of sources alike, so neither a source
with a third of all rows nor very many sources end in one task.

Cases: NULL and blank texts have size 0 and are taken like others (their copies
hold no word); a NULL source is a source of its own; a source without words has
the target 0, and nothing of it is taken; rows that repeat an id are separate
rows (equal rows are interchangeable); NULL ids are ordered as an empty id;
very long texts are one row like any other (a source of one long document is
taken or left whole); empty tables give empty results; other columns, clashing
names included, are only read by ``emit``, which keeps them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.components import written
from revlens.plans.prefix import running_sums

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 42
#: Expected copies are counted in these parts of a copy.
UNIT = 1 << 24
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _hashed(text: Column, seed: int, digits: int) -> Column:
    """The first hex digits of a seeded digest as a number."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) of rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumns({"absent": F.col("source").isNull(), "one": F.lit("")})
    each = running_sums(per, "one", ["absent", "source"], {"place": F.lit(1)})
    turn = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    each = each.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn).cast("bigint"))
    each = each.withColumn("bound", F.col("source_size") * most).drop("place")
    # the level at which a source reaches its bound, as an exact order
    whole = F.lit(_multiple(weights))
    level = F.col("bound").cast("decimal(38,0)") * (whole / F.col("weight")).cast("bigint")
    each = running_sums(each.withColumn("level", level), "one", ["level", "absent", "source"],
                        {"bounds": F.col("bound"), "weights": F.col("weight")})
    each = written(each, "mix-sources")
    total = each.agg(F.sum("source_size"), F.sum("weight")).first()     # two numbers
    words, shares = (F.lit(int(x or 0)).cast("decimal(19,0)") for x in total)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    # what all sources take at the level at which this one reaches its bound
    full = big("weight") * big("bounds") + big("bound") * (shares - big("weights")) <= big("weight") * words
    each = each.withColumn("full", full)
    bound, weight = each.agg(F.sum(F.expr("if(full, bound, 0)")), F.sum(F.expr("if(full, 0, weight)"))).first()
    level = float(int(total[0] or 0) - int(bound or 0)) / float(weight or 1)
    return each.select("source", "source_size", F.when(F.col("full"), F.col("bound").cast("double"))
                       .otherwise(F.lit(level) * F.col("weight").cast("double")).alias("target"))


def _multiple(weights: Sequence[int]) -> int:
    from math import lcm

    if not weights or any(int(w) != w or w < 1 for w in weights):
        raise ValueError("weights are whole numbers of 1 or more")
    return lcm(*[int(w) for w in weights])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    With ``keep`` the whole row travels along as the struct ``row``; else the
    text is read once and only numbers move."""
    cols = [docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"),
            F.xxhash64(docs[text_col]).alias("tie")]
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    sizes = written(docs.select(*cols, *([whole] if keep else [])), "mix-sizes")
    targets = source_targets(sizes.select("source", "size"), weights, most)
    t = targets.withColumnRenamed("source", "of")
    parts = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(
        F.least(F.lit(most * UNIT), F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5))).cast("bigint")
    rows = (sizes.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumns({"parts": parts, "shuffled": _hashed(F.col("doc_id"), seed, 15)}))
    rows = running_sums(rows, "source", ["size", "shuffled", "doc_id", "tie"], {"upto": F.col("parts")})
    offset = _hashed(F.col("source"), seed, 6)
    crossed = F.floor((F.col("upto") + offset) / UNIT) - F.floor((F.col("upto") - F.col("parts") + offset) / UNIT)
    return rows.select("doc_id", "source", "size", "source_size", "target", crossed.cast("bigint").alias("copies"),
                       *(["row"] if keep else []))


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken.  The
    rows move whole through the one range exchange of the prefix sums."""
    return (mix(docs, keep=True, **how).where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies", "source")


def brute_force(rows: Sequence[tuple], weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> list[tuple]:
    """(doc_id, size, source_size, target, copies) of (doc_id, text, source):
    shares by rounds, one loop over each source."""
    import re
    from fractions import Fraction
    from hashlib import md5

    def number(x, digits: int) -> int:
        return int(md5(f"{seed}:{'' if x is None else x}".encode()).hexdigest()[:digits], 16)

    docs = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    names = sorted({s for _, _, s in docs if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for _, _, s in docs)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = {s: sum(n for _, n, of in docs if of == s) for s in names}
    target, spare, free = dict.fromkeys(names, Fraction(0)), Fraction(sum(size.values())), set(names)
    while spare and free:
        shared = sum(weight[s] for s in free)
        for s in free:
            target[s] += spare * weight[s] / shared
        spare = Fraction(0)
        for s in sorted(free, key=str):
            if target[s] > most * size[s]:
                spare += target[s] - most * size[s]
                target[s] = Fraction(most * size[s])
                free.discard(s)
    out = []
    for s in names:
        parts = 0 if not size[s] else min(most * UNIT, int(float(target[s]) / size[s] * UNIT + 0.5))
        upto, offset = 0, number(s, 6)
        for d, n in sorted(((d, n) for d, n, of in docs if of == s), key=lambda r: (r[1], number(r[0], 15), r[0] is not None, r[0] or 0)):
            before, upto = upto, upto + parts
            out.append((d, n, size[s], float(target[s]), (upto + offset) // UNIT - (before + offset) // UNIT))
    return out
