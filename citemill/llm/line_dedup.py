"""Site-relative line dedup: a line that stands on too large a part of a host's pages is boilerplate.

Only DataFrame operations. Lines are counted by host with map-side sums. A host has fewer boilerplate
lines than (lines of an average page) / ratio, so its set is small and joins its pages as one array;
pages aren't cut into rows and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A line on more than this part of a host's pages goes, if it is on MIN_PAGES of them at least.
RATIO = 0.3
MIN_PAGES = 3
#: A host with at least one page in HOT_SHARE is large; there are at most so many. Those with up to
#: HOT_LINES boilerplate lines are broadcast: 8 bytes a line, 32 MB in all at most.
HOT_SHARE = 256
HOT_LINES = 16384

#: What is opened and never closed hides the rest of the page; no pattern looks past the next < for a tag's end,
#: so that each takes time in proportion to the page, whatever it holds.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
BREAKS = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|aside|main|title|head|body|html|pre|blockquote|hr|form|option)\b[^<>]*>"
TAGS = r"<[^<>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """The page's lines of text: hidden parts and tags removed, block tags end a line, white space collapsed."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAGS, "")
    lines = F.transform(F.split(text, r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x0B\f]+", " ")))
    return F.filter(lines, lambda x: x != "")


def drop_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: page_id, host, n_lines, n_dropped, text (the lines that stay, in order).

    A page counts once for a line it repeats, and loses all its places. Pages without a host aren't
    compared and keep all lines. Null and empty html has no lines and empty text, but counts in its
    host's total. Rows that repeat a page_id count each. Only page_id, url and html are read; an
    empty table gives an empty one.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    own = materialise(own, "lines")  # taking a page apart is most of the work: once, not for counts and for results
    named = own.where("host <> ''")
    totals = materialise(named.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    n = totals.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first().n
    on = named.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = on.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    sets = totals.join(common.groupBy("host").agg(F.collect_set("line").alias("drop")), "host", "left")
    none = F.array().cast("array<bigint>")
    sets = materialise(sets.select("host", F.coalesce("drop", none).alias("drop"), ((F.col("pages") * HOT_SHARE >= n) & (F.coalesce(F.size("drop"), F.lit(0)) <= HOT_LINES)).alias("hot")), "boilerplate")
    # The sets of the few largest hosts are broadcast, so their pages are never brought together.
    marked = own.join(F.broadcast(sets.where("hot")), "host", "left")
    others = marked.where("hot is null").drop("drop", "hot").join(sets.where("not hot").drop("hot"), "host", "left")
    joined = marked.where("hot is not null").select("page_id", "host", "lines", "drop").unionByName(others).withColumn("drop", F.coalesce("drop", none))
    kept = F.filter("lines", lambda x: ~F.array_contains("drop", F.xxhash64(x)))
    return joined.withColumn("kept", kept).select(
        "page_id", "host", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"),
    )
