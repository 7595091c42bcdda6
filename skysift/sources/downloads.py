"""Download scripts and link pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

_NO_CONTENT = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# The ampersand comes last, so that an escaped entity stays text.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# An opening anchor tag with its href value in one of the three quoting styles.
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""


def targets_in_lines(lines: DataFrame) -> DataFrame:
    """``curl`` lines to (filename, url, tic), other columns kept; lines lacking any part are dropped."""
    rest = [c for c in lines.columns if c != "value"]
    curl = lines.filter(F.col("value").rlike(r"^\s*curl"))
    urls = S.with_column_once(curl, "url", S.url_in_line(F.col("value"))).filter(F.col("url").isNotNull())
    files = S.with_column_once(urls, "filename", S.fits_name_in_url(F.col("url")))
    named = S.with_column_once(files, "tic", S.tic_from_name(F.col("filename")))
    return named.filter(F.col("tic") != 0).select("filename", "url", "tic", *rest)


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """Targets of all download scripts that match ``path``, with their script and place in it.

    ``place`` orders the lines of one script, also when the scan splits it: lines of an
    earlier block come first, and within a block the row ids follow the text.
    """
    place = F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("script"), place.alias("place")
    )
    return targets_in_lines(lines)


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html", pattern: str | None = None) -> DataFrame:
    """Anchor targets of every page: (key, href, position of the first occurrence), distinct per page.

    Anchors inside comments, scripts and style sheets do not count.
    """
    text = F.regexp_replace(html, _NO_CONTENT, " ")
    found = F.transform(F.regexp_extract_all(text, F.lit(_ANCHOR), 1), _plain_link)
    links = pages.select(key, F.posexplode(found).alias("position", "href")).filter(F.col("href") != "")
    if pattern is not None:
        links = links.filter(F.col("href").rlike(pattern))
    return links.groupBy(key, "href").agg(F.min("position").alias("position"))


def _plain_link(value: Column) -> Column:
    bare = F.regexp_replace(value, r"""^["']|["']$""", "")
    for entity, character in _ENTITIES.items():
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    return F.trim(bare)
