"""URL filters by a temporal list join.

Dated list entries (add or remove a pattern) become validity intervals, and every capture is judged
by the entries that were active when it was fetched. A pattern is a domain, which covers its
subdomains, or ``host/segment``, a host with the first segment of the path.

Captures are first reduced to distinct (host, segment, day) sites, so a host with a third of all
captures reaches the list join as one row per day and segment; the verdicts go back in one join whose
large partitions can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"
FOREVER = "9999-12-31"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(list_name, pattern, since, until)``: days ``since <= day < until`` on which a pattern is listed.

    ``entries`` has ``list_name, pattern, action ('add' or 'remove'), day``. A day's last word is
    ``remove`` if both occur. Rows with a null pattern, day or list and other actions are ignored;
    repeated rows change nothing. Adds that follow each other are one interval.
    """
    entries = entries.where("pattern is not null and day is not null and list_name is not null and action in ('add', 'remove')")
    daily = entries.groupBy("list_name", F.lower("pattern").alias("pattern"), "day").agg(F.min(F.col("action") == "add").alias("listed"))
    key = W.partitionBy("list_name", "pattern").orderBy("day")
    turns = daily.withColumn("was", F.lag("listed").over(key)).where("was is null or listed <> was")
    ends = F.coalesce(F.lead("day").over(key), F.lit(FOREVER).cast("date"))
    return turns.withColumn("until", ends).where("listed").select("list_name", "pattern", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row of ``captures(capture_id, url, fetched)`` with ``host, blocked, pattern, list_name, listed_since``.

    The verdict names the most specific active pattern (the longest; then the least pattern and list
    name). A null or hostless URL and a null fetch day are never blocked. Repeated captures repeat.
    Other columns are dropped; empty tables are fine on either side.
    """
    url = F.lower("url")
    captures = captures.select(
        "capture_id",
        "url",
        F.col("fetched").cast("date").alias("fetched"),
        F.regexp_extract(url, _HOST, 1).alias("host"),
        F.regexp_extract(url, _SEGMENT, 1).alias("segment"),
    )
    sites = captures.where("host <> '' and fetched is not null").select("host", "segment", "fetched").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = F.array_union(suffixes, F.array(F.concat_ws("/", "host", "segment")))
    looked_up = sites.withColumn("pattern", F.explode(keys))
    active = looked_up.join(validity_intervals(entries).hint("merge"), "pattern").where("since <= fetched and fetched < until")
    best = active.groupBy("host", "segment", "fetched").agg(
        F.min(F.struct((-F.length("pattern")).alias("rank"), "pattern", "list_name", "since")).alias("hit")
    )
    return captures.join(best.hint("merge"), ["host", "segment", "fetched"], "left").select(
        "capture_id",
        "url",
        "fetched",
        "host",
        F.col("hit").isNotNull().alias("blocked"),
        F.col("hit.pattern").alias("pattern"),
        F.col("hit.list_name").alias("list_name"),
        F.col("hit.since").alias("listed_since"),
    )
