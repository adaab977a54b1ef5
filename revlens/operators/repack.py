"""Changed-files-only review: packing again only where files have changed.

Next-fit forgets: a chunk depends on where it starts and on its files, and on
the first file behind it (which did not fit).  So chunks away from changed
files stay as they are, and so do their signatures.  ``repack`` takes the packed
files and chunk headers of the earlier corpus and the list of changes:

1. a block (a chunk, or the chunks of one oversized file) is dirty if a file in
   it, or the first file behind it, was changed, removed or added;
2. runs of dirty blocks are regions.  The files of a region are packed by
   themselves, together with the first file behind it.  If that file starts a
   chunk, as it did before, all that follows is unchanged; else the region is
   made longer by a growing number of blocks and packed again;
3. the other blocks keep their headers; chunks are numbered anew.

Regions are packed like projects (``packing``), so one that reaches to the end
of a huge project is spread over tasks as well.  Rounds are as many as the
longest region has doublings; each writes its regions and brings two numbers to
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators.chunking import hard_split, part_rows
from revlens.operators.packing import narrow_files, place_files
from revlens.operators.ranges import range_groups
from revlens.plans.prefix import ordinal, running_sums
from revlens.plans.session import materialized

_ORDER = ["lkey", "relative"]


@dataclass
class Repacked:
    chunks: DataFrame       #: project, chunk_id, n_files, tokens, signature, kept
    touched: DataFrame      #: project, relative: the files packed again (with the ones behind each region)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("project", F.when(F.col("project") != "", F.substring("project", 2, (1 << 31) - 1)))


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("project", F.coalesce(F.concat(F.lit("="), F.col("project")), F.lit("")))


def _blocks(placed: DataFrame, width: int) -> DataFrame:
    """Blocks of packed files: project, lkey, relative (of the first file),
    chunk_id (of the first chunk), n_chunks, block (from 1)."""
    starts = placed.where("pos = 0").select("project", F.lower("relative").alias("lkey"), "relative", "chunk_id",
                                            F.when(F.col("over"), F.ceil(F.col("chars") / width)).otherwise(1).cast("bigint").alias("n_chunks"))
    return ordinal(starts, "project", ["chunk_id"], "block")


def _dirty(old: DataFrame, added: DataFrame) -> DataFrame:
    """(project, block) that a change reaches; ``old`` are the changed and
    removed files where they were."""
    return (old.select("project", "block")
            .unionByName(old.where((F.col("pos") == 0) & (F.col("block") > 1)).select("project", (F.col("block") - 1).alias("block")))
            .unionByName(added.select("project", "block")).distinct())


def _added_at(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(project, relative, block) of added files: the block they fall into."""
    added = changes.where("change = 'added'").select("project", F.lower("relative").alias("lkey"), "relative", F.lit(0).alias("start"))
    at = running_sums(added.unionByName(blocks.select("project", "lkey", "relative", F.lit(1).alias("start"))), "project",
                      ["lkey", "relative", "start"], {"block": F.col("start")})
    return at.where("start = 0").select("project", "relative", F.greatest("block", F.lit(1).cast("bigint")).alias("block"))


def repack(files: DataFrame, changes: DataFrame, placed: DataFrame, headers: DataFrame, budget: int) -> Repacked:
    """New chunks of ``files`` after ``changes`` (project, relative, change:
    added, changed or removed), from the packed files (``packing.place_files``)
    and chunk headers (``chunking.chunk_headers``) of before."""
    width = max(K.MIN_SPLIT_CHARS, K.SPLIT_CHARS_PER_TOKEN * int(budget))
    changes = materialized(_key(changes.where("change <> 'unchanged'").select("project", "relative", "change")), "repack-changes")
    # the rounds below read numbers that are written once, not the corpora again
    placed = materialized(placed, "repack-before")
    blocks = materialized(_blocks(placed, width), "repack-blocks")
    of = blocks.select(F.col("project").alias("_p"), "chunk_id", "block")
    located = placed.join(of.withColumnRenamed("chunk_id", "_c"), (F.col("project") == F.col("_p")) & (F.col("chunk_id") == F.col("_c"))).drop("_p", "_c")
    # the numbers of changed and added files, and the block each falls into
    fresh_keys = changes.where("change <> 'removed'").select("project", "relative")
    fresh = materialized(narrow_files(files).join(fresh_keys, ["project", "relative"], "left_semi"), "repack-fresh")
    added = materialized(_added_at(changes, blocks), "repack-added")
    dirty = _dirty(located.join(changes.where("change <> 'added'").select("project", "relative"), ["project", "relative"]), added).select("project", F.col("block").alias("lo"), F.col("block").alias("hi"))
    last = blocks.groupBy("project").agg(F.max("block").alias("last"))
    changed_at = located.join(changes.where("change = 'changed'").select("project", "relative"), ["project", "relative"], "left_semi")
    homes = changed_at.select("project", "relative", "block").unionByName(added)
    stay = located.join(changes.select("project", "relative"), ["project", "relative"], "left_anti").select(
        "project", "relative", F.lower("relative").alias("lkey"), "size", "lines", "tokens", "chars", "block")
    now = materialized(stay.unionByName(fresh.join(homes, ["project", "relative"]).select(*stay.columns)), "repack-now")
    first_of = blocks.select("project", "relative", F.col("block").alias("first_of"))

    def packed_regions(regions: DataFrame) -> DataFrame:
        """The files of the regions and the first one behind each (guard)."""
        rows = regions.select("project", "region", "hi", F.explode(F.sequence("lo", F.col("hi") + 1)).alias("block"))
        mine = now.join(rows, ["project", "block"]).join(first_of.withColumnsRenamed({"project": "_p", "relative": "_r"}),
                                                         (F.col("project") == F.col("_p")) & (F.col("relative") == F.col("_r")), "left")
        mine = mine.where((F.col("block") <= F.col("hi")) | F.col("first_of").isNotNull())
        name = F.concat(F.col("project"), F.lit("\u0000"), F.col("region").cast("string"))
        narrow = mine.select(name.alias("project"), "relative", "lkey", "size", "lines", "tokens", "chars")
        out = place_files(narrow, int(budget), width)
        back = mine.select(name.alias("_n"), F.col("relative").alias("_r"), "project", "region", (F.col("block") > F.col("hi")).alias("guard"))
        return out.withColumnRenamed("project", "_of").join(back, (F.col("_of") == F.col("_n")) & (F.col("relative") == F.col("_r"))).drop("_of", "_n", "_r")

    def grown(spans: DataFrame) -> DataFrame:
        """Spans cut at the end of their project and joined where they touch."""
        cut = spans.join(last, "project").select("project", "lo", F.least("hi", "last").alias("hi"))
        chained = range_groups(cut, ["project"], "lo", "hi", slack=1, name="region")
        return chained.groupBy("project", "region").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    spans, more = materialized(dirty, "repack-dirty"), 1
    while True:
        regions = materialized(grown(spans), "repack-regions")
        made = materialized(packed_regions(regions), "repack-placed")
        # the file behind does not start a chunk as it did: the region must be longer
        open_ = made.where("guard and pos > 0").select("project", "region")
        if open_.isEmpty():
            break
        spans = (regions.join(open_.withColumn("open", F.lit(True)), ["project", "region"], "left")
                 .select("project", "lo", F.when(F.col("open"), F.col("hi") + more).otherwise(F.col("hi")).alias("hi")))
        more *= 2
    # projects that are new as a whole have no block: packed like a region of their own
    whole_new = fresh.join(last.select("project"), "project", "left_anti")
    new = place_files(whole_new, int(budget), width).select("*", F.lit(1).cast("bigint").alias("region"), F.lit(False).alias("guard"))
    made = made.unionByName(new.select(*made.columns)).where("not guard")
    again = _region_chunks(made, _key(files.select("project", "relative", "tokens", "text")), int(budget), width)

    inside = regions.select("project", F.explode(F.sequence("lo", "hi")).alias("block"))
    kept_blocks = blocks.join(inside, ["project", "block"], "left_anti")
    chunk_of = kept_blocks.select("project", "block", F.posexplode(F.sequence("chunk_id", F.col("chunk_id") + F.col("n_chunks") - 1)).alias("inner", "chunk_id"))
    kept = (_key(headers).select("project", "chunk_id", "n_files", "tokens", "signature").join(chunk_of, ["project", "chunk_id"])
            .select("project", F.col("block").alias("slot"), F.col("inner").cast("bigint").alias("inner"), "n_files", "tokens", "signature", F.lit(True).alias("kept")))
    slots = regions.select("project", "region", F.col("lo").alias("slot"))
    redone = again.join(slots, ["project", "region"], "left").select(
        "project", F.coalesce("slot", F.lit(0).cast("bigint")).alias("slot"), F.col("chunk_id").alias("inner"), "n_files", "tokens", "signature", F.lit(False).alias("kept"))
    numbered = ordinal(kept.unionByName(redone), "project", ["slot", "inner"], "chunk_id")
    touched = made.select("project", "relative")
    return Repacked(_named(numbered.select("project", "chunk_id", "n_files", "tokens", "signature", "kept")), _named(touched))


def _region_chunks(made: DataFrame, files: DataFrame, budget: int, width: int) -> DataFrame:
    """Headers of the chunks of packed regions (C6); only oversized files of
    the regions are read for their parts."""
    member = F.concat_ws(":", "relative", F.col("lines").cast("string"), F.col("tokens").cast("string"), F.col("chars").cast("string"))
    small = made.where(~F.col("over")).select("project", "region", "chunk_id", "pos", "tokens", member.alias("member"))
    big = made.where("over").select("project", "region", "relative", F.col("chunk_id").alias("first"))
    texts = files.where(F.col("tokens") > budget).join(big, ["project", "relative"])
    parts = part_rows(hard_split(texts, F.lit(width))).select(
        "project", "region", (F.col("first") + F.col("part_no") - 1).alias("chunk_id"), F.lit(0).cast("int").alias("pos"), F.col("part_tokens").alias("tokens"),
        F.concat_ws(":", "part_relative", F.col("part_lines").cast("string"), F.col("part_tokens").cast("string"), F.col("part_chars").cast("string")).alias("member"))
    items = F.array_sort(F.collect_list(F.struct("pos", "member")))     # at most the budget's members
    return small.unionByName(parts).groupBy("project", "region", "chunk_id").agg(
        F.count("*").alias("n_files"), F.sum("tokens").cast("bigint").alias("tokens"),
        F.sha2(F.array_join(F.transform(items, lambda m: m["member"]), "|"), 256).alias("signature"))
