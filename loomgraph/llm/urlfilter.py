"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries: (scope, value, action, since), scope `host`, `domain` (the host or any below it) or
`prefix` (host and first path segment), action `block`, `allow` or `drop` (the entry ends). Each entry holds from its date
until the next one of its scope and value: LEAD makes validity intervals, which don't overlap. A capture is joined, by
each key its URL has, with the interval that is open at its fetch time. The most specific key decides: prefix before
host, host before domain, longer domains before shorter ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Interval rows up to which the list is sent to all tasks, some 100 bytes each; a longer one is joined by key.
SENT = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.lower(host)


def first_segment(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """scope, value, action, since, until (null: still open). Of entries of one moment the strictest holds: block, allow, drop."""
    strict = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    clean = entries.select("scope", F.lower("value").alias("value"), "action", "since").dropna()
    at_once = clean.groupBy("scope", "value", "since").agg(F.min_by("action", strict).alias("action"))
    until = F.lead("since").over(Window.partitionBy("scope", "value").orderBy("since"))
    return at_once.withColumn("until", until).filter(F.col("action") != "drop").select("scope", "value", "action", "since", "until")


def keys_of(host: Column, segment: Column) -> Column:
    """The keys of a URL as array<struct<scope, value, rank>>; a higher rank decides before a lower one."""
    labels = F.split(host, r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("scope"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value"), (F.size(labels) - i).alias("rank")),
    )
    own = F.array(F.struct(F.lit("host").alias("scope"), host.alias("value"), F.lit(1000).alias("rank")), F.struct(F.lit("prefix").alias("scope"), F.concat(host, F.lit("/"), F.lower(segment)).alias("value"), F.lit(1001).alias("rank")))
    return F.when(host == "", F.array().cast("array<struct<scope:string,value:string,rank:int>>")).otherwise(F.concat(tails, own))


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, fetched, host, verdict (block, allow or none), scope and value that decided, for every row of captures.

    Captures without a host or time have the verdict none, entries without a scope, value, action or date don't count. Null
    ids stay null, repeated rows are each returned, long URLs are taken whole, other columns are not looked at. Of entries of
    one moment the strictest holds. Empty tables work. A list over SENT intervals is joined by key; as a key's captures need
    not meet, Spark can split those of a frequent one.
    """
    rows = materialise(captures.select("page_id", "url", "fetched", host_of(F.col("url")).alias("host"), F.monotonically_increasing_id().alias("n")), "captures")
    keyed = rows.select("n", "fetched", F.explode(keys_of(F.col("host"), first_segment(F.col("url")))).alias("k")).select("n", "fetched", "k.*")
    open_at = intervals(entries)
    open_at = F.broadcast(open_at) if open_at.count() <= SENT else open_at.hint("merge")
    e = open_at.withColumnsRenamed({"scope": "e_scope", "value": "e_value"})
    active = keyed.join(e, (F.col("scope") == F.col("e_scope")) & (F.col("value") == F.col("e_value")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = active.groupBy("n").agg(F.max_by(F.struct("action", "scope", "value"), F.col("rank")).alias("b"))
    out = rows.join(best, "n", "left")
    return out.select("page_id", "url", "fetched", "host", F.coalesce("b.action", F.lit("none")).alias("verdict"), F.col("b.scope").alias("scope"), F.col("b.value").alias("value"))


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: these tables have none, so page_id decides a day of 2023 or 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int")).alias("fetched"))


def sample_entries(spark) -> DataFrame:
    """A fixed list whose entries come, change and go, for hosts as these tables have them."""
    log = [
        ("domain", "example.net", "block", "2023-02-01"), ("domain", "example.net", "drop", "2023-08-15"), ("domain", "example.net", "block", "2024-03-01"),
        ("domain", "example.org", "allow", "2023-05-05"), ("domain", "example.org", "block", "2024-06-30"),
        ("domain", "com", "block", "2024-11-01"), ("domain", "com", "block", "2024-11-01"), ("domain", "com", "drop", "2024-12-01"),
        ("host", "m.ththth.example.net", "allow", "2023-03-10"), ("host", "blog.ththan.example.net", "allow", "2024-04-01"), ("host", "therha.example.com", "block", "2023-01-20"),
        ("host", "therha.example.com", "drop", "2024-01-20"), ("host", "therin.example.net", "allow", "2024-05-01"), ("host", "therin.example.net", "block", "2024-09-01"),
        ("prefix", "therha.example.com/en", "allow", "2023-09-01"), ("prefix", "blog.tiontion.example.com/en", "block", "2023-07-01"), ("prefix", "blog.tiontion.example.com/en", "drop", "2024-07-01"),
    ]
    return spark.createDataFrame(log, "scope string, value string, action string, since string").withColumn("since", F.col("since").cast("date"))


SQL = """
WITH log(scope, value, action, since) AS (VALUES
('domain','example.net','block',DATE '2023-02-01'),('domain','example.net','drop',DATE '2023-08-15'),('domain','example.net','block',DATE '2024-03-01'),
('domain','example.org','allow',DATE '2023-05-05'),('domain','example.org','block',DATE '2024-06-30'),
('domain','com','block',DATE '2024-11-01'),('domain','com','drop',DATE '2024-12-01'),
('host','m.ththth.example.net','allow',DATE '2023-03-10'),('host','blog.ththan.example.net','allow',DATE '2024-04-01'),('host','therha.example.com','block',DATE '2023-01-20'),
('host','therha.example.com','drop',DATE '2024-01-20'),('host','therin.example.net','allow',DATE '2024-05-01'),('host','therin.example.net','block',DATE '2024-09-01'),
('prefix','therha.example.com/en','allow',DATE '2023-09-01'),('prefix','blog.tiontion.example.com/en','block',DATE '2023-07-01'),('prefix','blog.tiontion.example.com/en','drop',DATE '2024-07-01')),
spans AS (SELECT *, lead(since) OVER (PARTITION BY scope, value ORDER BY since) AS until FROM log),
caps AS (SELECT page_id, url, DATE '2023-01-01' + ((page_id * 37) % 730)::INTEGER AS fetched,
 lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
 lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1)) AS seg FROM pages),
hits AS (SELECT c.page_id, s.action, s.scope, s.value, CASE s.scope WHEN 'prefix' THEN 3000 WHEN 'host' THEN 2000 ELSE length(s.value) END AS rank
 FROM caps c JOIN spans s ON s.action <> 'drop' AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until)
 AND CASE s.scope WHEN 'host' THEN c.host = s.value WHEN 'prefix' THEN c.host || '/' || c.seg = s.value ELSE c.host = s.value OR ends_with(c.host, '.' || s.value) END),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank DESC) = 1)
SELECT c.page_id, c.url, c.fetched, c.host, coalesce(b.action, 'none') AS verdict, b.scope, b.value FROM caps c LEFT JOIN best b USING (page_id)
"""
