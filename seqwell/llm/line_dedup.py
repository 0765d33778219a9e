"""Line dedup by site-relative frequency, in DataFrame functions only.

Lines are grouped by site; the number of pages of a site that hold a line, divided by the number of the site's pages, is
the line's frequency. Lines over the boilerplate ratio are dropped from every page of the site; the other lines stay as
they are, in order.

Scale: pages are counted per (site, line) key, a 64-bit hash, with partial sums before the shuffle, so that neither a hot
site nor a hot line gathers in a task. A site has at most (mean lines per page / ratio) lines over the ratio, so the list of
them is of the size of a few pages. Pages meet their site's list in one join, in which texts are moved once: pages of a site
with one of `HOT` pages or more, of which there are HOT sites at most, are dealt over several tasks, each with a copy of it.

Defined results: a line is what stands between ``\\n``; lines of only spaces, tabs and ``\\r`` are never counted or dropped;
a line repeated in a page counts once for it and all its occurrences go; rows with a null site are one site; every row is
a page, also those with null or empty text, which come back unchanged; repeated rows are pages of their own; a page whose
lines all go has the text ``''``; a column lines_dropped is replaced, further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A site with one of so many pages is hot.
HOT = 500


def _keys(text: Column, site: Column) -> Column:
    """A key per line, null for blank lines."""
    lines = F.split(text, "\n", -1)
    return F.transform(lines, lambda x: F.when(F.trim(x, F.lit(" \t\r")) != "", F.xxhash64(site, x)))


def site_line_dedup(pages: DataFrame, *, site: str = "source", text: str = "text", percent: int = 5, min_pages: int = 5) -> DataFrame:
    """`pages` with `text` cleaned, and lines_dropped (long). Lines on more than `percent` % of the pages of their site, and on `min_pages` at least, go."""
    of = F.xxhash64(F.isnull(F.col(site)), F.col(site))
    lined = pages.select(of.alias("_site"), F.explode(F.array_compact(F.array_distinct(_keys(F.col(text), of)))).alias("_k"))
    found = lined.groupBy("_k").agg(F.count("*").alias("_n"), F.min("_site").alias("_site")).where(F.col("_n") >= min_pages)
    total = pages.groupBy(of.alias("_site")).agg(F.count("*").alias("_pages"))
    common = found.join(total, "_site").where(F.col("_n") * 100 > F.col("_pages") * percent)
    gone = common.groupBy("_site").agg(F.collect_list("_k").alias("_gone"))

    # a power of two, so that plans differ in few numbers
    every = 1 << max(0, pages.count() - 1).bit_length()
    hot = F.broadcast(total.where(F.col("_pages") * HOT >= every).select("_site", F.least("_pages", F.ceil(F.col("_pages") * HOT / every)).cast("int").alias("_tasks")))
    tasks = F.coalesce("_tasks", F.lit(1))
    copied = gone.join(hot, "_site", "left").select("_site", "_gone", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("_at"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), of.alias("_site"), F.monotonically_increasing_id().alias("_id"))
    rows = rows.join(hot, "_site", "left").select("row", "_site", F.pmod("_id", tasks).cast("int").alias("_at"))
    met = rows.join(copied.hint("shuffle_hash"), ["_site", "_at"], "left")
    own = F.col("row")[text]
    lines = F.split(own, "\n", -1)
    pairs = F.arrays_zip(lines.alias("line"), _keys(own, F.col("_site")).alias("k"))
    kept = F.filter(pairs, lambda x: x["k"].isNull() | ~F.array_contains("_own", F.coalesce(x["k"], F.lit(0))))
    met = met.withColumn("_own", F.array_intersect("_gone", _keys(own, F.col("_site"))))
    met = met.withColumn("_kept", F.when(F.size("_own") > 0, F.transform(kept, lambda x: x["line"])))
    dropped = F.when(F.col("_kept").isNull(), 0).otherwise(F.size(lines) - F.size("_kept"))
    new = F.when(F.col("_kept").isNull(), own).otherwise(F.array_join("_kept", "\n"))
    columns = [new.alias(text) if c == text else F.col("row")[c].alias(c) for c in pages.columns if c != "lines_dropped"]
    return met.select(*columns, dropped.cast("long").alias("lines_dropped"))
