"""Exact length histogram: documents by encoded length, with suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.llm import pieces


def histogram(docs: DataFrame, text: str = "text", path: str = pieces.MODEL) -> DataFrame:
    """length, n_docs: how many rows of `docs` encode to each number of tokens.

    The only shuffle carries one row per distinct length and map task. Every row
    counts, repeated ones too; NULL and empty texts have length 0; other columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.lit(0).alias("_k"), F.col(text).alias("_t"))
    return pieces.token_counts(rows, "_t", "_k", path).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with what every question about a context limit needs.

    For each length L that occurs, as a limit: n_docs of that length; docs_upto
    and tokens_upto of documents of at most L tokens; docs_over and tokens_over
    of longer ones (the suffix sums); truncated_total = tokens left when every
    document is cut to L; quantile = share of documents of at most L tokens.
    The windows run over distinct lengths, whose number is bounded by the
    longest document, not by the number of documents.
    """
    up = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("length") * F.col("n_docs")
    summed = hist.select(
        "length",
        "n_docs",
        F.sum("n_docs").over(up).alias("docs_upto"),
        F.sum(tokens).over(up).alias("tokens_upto"),
        F.coalesce(F.sum("n_docs").over(over), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(tokens).over(over), F.lit(0)).alias("tokens_over"),
    )
    return summed.withColumns({
        "truncated_total": F.col("tokens_upto") + F.col("length") * F.col("docs_over"),
        "quantile": F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_over")),
    })


def totals_at(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For any limits, also ones that no document has: docs and tokens within, cut documents, truncated_total."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    n, size = F.coalesce("n_docs", F.lit(0)), F.coalesce("length", F.lit(0))
    fits = size <= F.col("context_limit")
    return asked.join(hist, F.lit(True), "left").groupBy("context_limit").agg(
        F.sum(F.when(fits, n).otherwise(0)).alias("docs_within"),
        F.sum(F.when(fits, n * size).otherwise(0)).alias("tokens_within"),
        F.sum(F.when(~fits, n).otherwise(0)).alias("docs_cut"),
        F.sum(n * F.least(size, "context_limit")).alias("truncated_total"),
    )


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share q, the least length that at least q of the documents don't exceed; no rows for no documents."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    sums = suffix_sums(hist).select("length", "quantile")
    return asked.join(sums, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
