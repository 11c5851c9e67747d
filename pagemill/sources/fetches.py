"""Fetched pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def fetches_from_pages(pages: DataFrame) -> DataFrame:
    """A table of pages as successful fetches without redirects."""
    return pages.select(
        "*",
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.lit(None).cast("string").alias("error"),
    )


def judge_fetches(fetches: DataFrame, max_length: int = 5 * 1024 * 1024) -> DataFrame:
    """Final ``success``, ``status_code`` and ``error`` of each fetch attempt.

    Without a response (null status, or the 0 that stands for it) the status is 0
    and the recorded error stays. Otherwise the first that applies: status of 400 or
    more, a header that is not HTML, a declared length over ``max_length`` bytes. A
    missing length passes. Judging twice changes nothing.
    """
    # The texts of the outcomes.
    header = F.coalesce("content_type", F.lit(""))
    error = (
        F.when(F.coalesce("status_code", F.lit(0)) == 0, F.coalesce("error", F.lit("no response")))
        .when(F.col("status_code") >= 400, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
        .when(~F.contains(F.lower(header), F.lit("text/html")), F.concat(F.lit("non-HTML content type: "), header))
        .when(
            F.col("content_length") > max_length,
            F.concat(F.lit("response too large: "), F.col("content_length").cast("string"), F.lit(" bytes")),
        )
    )
    judged = fetches.withColumns(
        {
            "error": error,
            "success": error.isNull(),
            "final_url": F.coalesce("final_url", "url"),
            "status_code": F.coalesce("status_code", F.lit(0)),
            "content_type": header,
        }
    )
    if "html" in fetches.columns:
        judged = judged.withColumn("html", F.when(F.col("success"), F.col("html")))
    return judged

