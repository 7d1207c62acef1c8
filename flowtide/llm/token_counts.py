"""Exact token counts: a histogram of encoded lengths answers every context limit.

Documents are aggregated by encoded length; all later work is on the
histogram, one row per distinct length.  Suffix sums over it give, for a
context limit L equal to a row's length, the documents and tokens at or above
L, the tokens kept when every document is truncated to L, and the rank range
that answers quantiles.  Limits between two rows follow by ``at_limits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm import tokens
from flowtide.llm.common import map_rows, pick
from flowtide.session import cut

BAND = 256


class _Lengths:
    def __init__(self, paths):
        self.paths = paths

    def __call__(self, rows):
        encode = tokens.encoder(*self.paths)
        for (text,) in rows:
            yield (len(encode(text)),)


def encoded_lengths(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: n_tokens.  Null and empty texts have length 0."""
    return map_rows(pick(docs, "text"), "n_tokens long", _Lengths(paths or tokens.default_paths()))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs; combined inside each task before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length L, in any order:

    n_tokens (L), n_docs of that length, docs_from / tokens_from (documents at
    least that long, their tokens), docs_to (documents at most that long),
    total_docs, total_tokens, truncated_tokens (tokens left when all are cut to
    L), share_to (docs_to / total_docs: the quantile L answers).

    Sums run inside bands of ``BAND`` lengths and over the few band totals, so
    no task sees the whole histogram.  An empty input gives no row.
    """
    h = hist.withColumn("band", F.floor(F.col("n_tokens") / BAND)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    over = Window.orderBy(F.col("band").desc())
    everything = Window.partitionBy()
    bands = bands.select(
        "band",
        (F.sum("b_docs").over(over) - F.col("b_docs")).alias("above_docs"),
        (F.sum("b_tokens").over(over) - F.col("b_tokens")).alias("above_tokens"),
        F.sum("b_docs").over(everything).alias("total_docs"),
        F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("band").orderBy(F.col("n_tokens").desc())
    h = h.join(bands, "band")
    return h.select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("above_docs") + F.sum("n_docs").over(inside)).alias("docs_from"),
        (F.col("above_tokens") + F.sum("tokens").over(inside)).alias("tokens_from"),
    ).select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", (F.col("total_docs") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
        "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs")).alias("share_to"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over (longer than the limit), truncated_tokens, for any limits.

    The answer for a limit comes from the shortest length at or above it:
    everything shorter is whole, everything from there on is cut to the limit.
    """
    wanted = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    first = (
        sums.join(F.broadcast(wanted), F.col("n_tokens") >= F.col("limit"))
        .groupBy("limit").agg(F.min_by(F.struct("n_tokens", "n_docs", "docs_from", "tokens_from", "total_tokens"), "n_tokens").alias("s"))
    )
    all_of = sums.agg(F.max("total_tokens").alias("whole"))
    return wanted.join(first, "limit", "left").join(F.broadcast(all_of)).select(
        "limit",
        F.coalesce(F.col("s.docs_from") - F.when(F.col("s.n_tokens") == F.col("limit"), F.col("s.n_docs")).otherwise(0), F.lit(0)).alias("docs_over"),
        F.coalesce(F.col("s.total_tokens") - F.col("s.tokens_from") + F.col("limit") * F.col("s.docs_from"), F.col("whole"), F.lit(0)).alias("truncated_tokens"),
    )


def token_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """The suffix sums of all documents.

    The histogram is stored first, because bands and rows both read it and the
    texts should be encoded once.
    """
    return suffix_sums(cut(length_histogram(encoded_lengths(docs, paths))))
