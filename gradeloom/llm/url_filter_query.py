"""The URL filter over the ``pages`` table.

The table has neither fetch days nor a block list, so both are derived from it by fixed rules: a page
is fetched on day ``page_id * 37 mod 366`` of 2024; every host is listed, delisted and perhaps listed
again on days that its MD5 digest gives, if its name looks like spam or its digest says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import judged

_DERIVED = """
hosts AS (SELECT DISTINCT regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host FROM pages),
digests AS (SELECT host, md5(host) AS d FROM hosts WHERE host <> ''),
numbers AS (
  SELECT host,
    (instr('0123456789abcdef', substr(d, 1, 1)) - 1) * 16 + instr('0123456789abcdef', substr(d, 2, 1)) - 1 AS a,
    (instr('0123456789abcdef', substr(d, 3, 1)) - 1) * 16 + instr('0123456789abcdef', substr(d, 4, 1)) - 1 AS b,
    (instr('0123456789abcdef', substr(d, 5, 1)) - 1) * 16 + instr('0123456789abcdef', substr(d, 6, 1)) - 1 AS c,
    host LIKE '%casino%' OR host LIKE '%bets%' OR host LIKE '%pills%' OR host LIKE '%ads-%' AS spam
  FROM digests
),
entries AS (
  SELECT 'spam' AS list_name, host AS pattern, 'add' AS action, b AS n FROM numbers WHERE spam OR a < 48
  UNION ALL SELECT 'spam', host, 'remove', b + 40 + c % 100 FROM numbers WHERE (spam AND a < 128) OR a < 40
  UNION ALL SELECT 'spam', host, 'add', b + 160 + c % 50 FROM numbers WHERE a < 24
  UNION ALL SELECT 'legal', concat(host, '/en'), 'add', c FROM numbers WHERE a % 11 = 0
)
"""


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries that were active on its fetch day."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    entries = spark.sql(f"WITH pages AS (SELECT * FROM {{pages}}), {_DERIVED} SELECT * FROM entries", pages=pages)
    entries = entries.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n").cast("int")))
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    found = judged(pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched")), entries)
    return found.withColumnRenamed("capture_id", "page_id")


ORACLE = f"""
WITH {_DERIVED},
daily AS (
  SELECT list_name, pattern, DATE '2024-01-01' + CAST(n AS INTEGER) AS day, bool_and(action = 'add') AS listed FROM entries GROUP BY ALL
),
turns AS (SELECT *, lag(listed) OVER (PARTITION BY list_name, pattern ORDER BY day) AS was FROM daily),
changes AS (
  SELECT list_name, pattern, day AS since, listed,
    coalesce(lead(day) OVER (PARTITION BY list_name, pattern ORDER BY day), DATE '9999-12-31') AS until
  FROM turns WHERE was IS NULL OR listed <> was
),
captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS fetched,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment
  FROM pages
),
hits AS (
  SELECT page_id, pattern, list_name, since,
    row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern, list_name, since) AS nth
  FROM captures JOIN changes
    ON listed AND since <= fetched AND fetched < until
    AND (host = pattern OR ends_with(host, '.' || pattern) OR host || '/' || segment = pattern)
)
SELECT page_id, url, fetched, host, nth IS NOT NULL AS blocked, pattern, list_name, since AS listed_since
FROM captures LEFT JOIN (SELECT * FROM hits WHERE nth = 1) USING (page_id)
"""
