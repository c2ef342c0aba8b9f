"""Search-result texts of pages: audit and fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.values import filled, trimmed

ROBOTS = ("index,follow", "noindex,nofollow", "noindex,follow", "index,nofollow")


def within(text: Column, least: int, most: int) -> Column:
    """empty, outside or good: by the length of the trimmed text."""
    n = F.length(trimmed(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty").when((n < least) | (n > most), "outside").otherwise("good")


def seo_audit(df: DataFrame) -> DataFrame:
    """df with title_state, description_state, and canonical_ok and robots_ok where it has those columns."""
    checks = {"title_state": within(F.col("title"), 45, 60)}
    if "description" in df.columns:
        checks["description_state"] = within(F.col("description"), 120, 160)
    if "canonical_url" in df.columns:
        checks["canonical_ok"] = F.coalesce(F.col("canonical_url").rlike(r"(?i)\Ahttps?://.+"), F.lit(False))
    if "robots" in df.columns:
        checks["robots_ok"] = F.coalesce(F.col("robots").isin(*ROBOTS), F.lit(False))
    return df.withColumns(checks)


def seo_fill(df: DataFrame) -> DataFrame:
    """Empty og and twitter texts from the page's own, robots and card with their defaults."""
    own = lambda c, *others: filled(F.col(c), *[F.col(o) if isinstance(o, str) else o for o in others], F.lit(""))
    return df.withColumns({"og_title": own("og_title", "title"), "og_description": own("og_description", "description"), "og_image": own("og_image"), "twitter_title": own("twitter_title", "og_title", "title"), "twitter_description": own("twitter_description", "og_description", "description"), "twitter_image": own("twitter_image", "og_image"), "robots": filled(F.col("robots"), F.lit("index,follow")), "twitter_card": filled(F.col("twitter_card"), F.lit("summary_large_image"))})
