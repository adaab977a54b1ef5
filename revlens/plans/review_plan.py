"""The offline review, end to end, as one lazy plan per stage.

corpus -> reviewable files -> budget packing (D3) -> rule replies (E1, in
place of a model) -> parse (E2-E5) -> dedup / rank (E10, E11) -> status,
counts and review records (E12-E14) -> report rows (E16).  Every stage is a
DataFrame; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import constants as K
from revlens.operators import chunking as D
from revlens.operators import corpus as C
from revlens.operators import review as E
from revlens.plans.session import ensure_checkpoint_dir
from revlens.sources import fixtures as V


@dataclass
class Review:
    files: DataFrame
    members: DataFrame
    chunks: DataFrame
    replies: DataFrame
    parsed: DataFrame
    unique: DataFrame
    ranked: DataFrame
    reviews: DataFrame
    summaries: DataFrame
    positives: DataFrame
    recommendations: DataFrame
    totals: DataFrame

    def report(self) -> DataFrame:
        """E16 report rows (project, section, seq, html), built on demand."""
        return E.report_rows(self.reviews, E.finding_blocks(self.ranked), self.summaries, self.positives, self.recommendations)


def review_corpus(files: DataFrame, budget: int, provider: str, model: str, context: int) -> Review:
    """Run the offline review over a files table (any source: A1 scan or A3)."""
    rv = C.reviewable(files)
    ensure_checkpoint_dir(files.sparkSession)
    # members (no text) feed the member-text join and the reply grouping
    members = D.pack_chunks(rv, budget).checkpoint(eager=True)
    # rules read each member's own text (a whole file or one part), as a
    # model reviewing that chunk would: line numbers are within the member.
    # Member texts are formed in place (oversized files split where they
    # are read), so no text is shuffled; only findings meet the chunk table.
    replies = E.rule_replies(E.rule_findings(D.member_texts(rv, budget)), members)
    # the parsed replies feed every later stage: cut the lineage once, into
    # the session's checkpoint directory (survives executor loss), without
    # the raw text, of which only the length is read later.
    parsed = (E.parse_replies(replies.withColumn("raw_chars", F.length("raw"))).drop("raw", "cleaned").checkpoint(eager=True))
    heads = parsed.select("project", "chunk_id", "n_files", "tokens", "signature")
    usage = F.create_map(F.lit("prompt_tokens"), (F.col("tokens") + K.REQUEST_OVERHEAD).cast("double"),
                         F.lit("completion_tokens"), F.greatest(F.lit(1.0), F.round(F.col("raw_chars") / K.CHARS_PER_TOKEN)))
    unique = E.dedup_findings(E.explode_findings(parsed))
    ranked = E.rank_findings(unique)
    totals = C.project_totals(rv, folder=True)
    reviews = E.review_records(parsed, usage, provider, model, context, totals)
    summ = E.summaries(parsed)
    pos = E.point_list(parsed, "positive_points")
    rec = E.point_list(parsed, "recommendations")
    return Review(rv, members, heads, replies, parsed, unique, ranked, reviews, summ, pos, rec, totals)


def offline_review(spark: SparkSession, data_dir: str, budget: int = 3_100, provider: str = "groq",
                   model: str = "openai/gpt-oss-20b", context: int = 131_072) -> Review:
    """The flagship: the corpus view of the driver tables reviewed offline."""
    files = C.corpus_from_table(V.files_v(spark, data_dir))
    return review_corpus(files, budget, provider, model, context)
