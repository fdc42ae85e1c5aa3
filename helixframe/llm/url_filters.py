"""URL filter by a dated list.

The list has entries (key, listed_at, action, category): from that time on, until the key's next
entry, its action is 'block', 'allow' or 'none'. A key is a host, a domain above it, or a host with
the first segment of the path. Entries become intervals; each capture is joined to those of its own
keys that are active at its fetch time, and the longest of these keys decides.

Only distinct captures are joined: a URL that is captured a million times at one time counts once.
The as-of join puts a key's entries and captures behind each other in the order of time, where the last
entry before a capture is the one that is active; no capture meets more than that one. A key of very many
captures is dealt over several groups, each with all the key's entries.

Defined results: a null URL, or one without a host, has no keys and passes; a null fetch time meets
no interval and passes; equal rows each get a row; of entries with the same key and time the
last in the order of action and category counts; an empty list blocks nothing; a URL of any length is
read whole; an empty table of captures gives an empty result. Columns of captures that are named as one of
the result's give way to it; others, of whatever name, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
FIRST_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)"
#: Captures of one key beyond which they are dealt over several groups.
GROUP_ROWS = 200_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys_of(url: Column) -> Column:
    """Host and its domains of two labels or more, and host with the first path segment."""
    host, segment = host_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), FIRST_SEGMENT, 1)
    labels = F.split(host, r"\.")
    count = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    with_path = F.when(segment != "", F.array(F.concat(host, segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, with_path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, category, valid_from, valid_to (null: still so)."""
    last = entries.where("key is not null and listed_at is not null").groupBy("key", "listed_at").agg(F.max(F.struct("action", "category")).alias("_e"))
    until = F.lead("listed_at").over(Window.partitionBy("key").orderBy("listed_at"))
    return last.select("key", "_e.action", "_e.category", F.col("listed_at").alias("valid_from"), until.alias("valid_to"))


def as_of(captures: DataFrame, active: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """url, fetched_at, key of captures with the interval of active(key, action, category, valid_from, valid_to) that holds then.

    Keys of more than group_rows captures are dealt over groups by a hash of the capture.
    """
    often = captures.groupBy("key").agg(F.ceil(F.count("*") / group_rows).cast("int").alias("_groups"))
    listed = common.cut(active.join(often, "key"))  # entries of keys that no capture has are gone
    keys = listed.select("key", "_groups").distinct()
    entries = listed.withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    named = F.struct("action", "category", "valid_from", "valid_to").alias("_entry")
    entries = entries.select("key", "_group", F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("url"), named)
    dealt = captures.join(keys, "key").withColumn("_group", F.pmod(F.xxhash64("url", "fetched_at"), F.col("_groups")).cast("int"))
    dealt = dealt.select("key", "_group", F.col("fetched_at").alias("_at"), F.lit(1).alias("_kind"), "url", F.lit(None).cast(entries.schema["_entry"].dataType).alias("_entry"))
    by_time = Window.partitionBy("key", "_group").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    last = entries.unionByName(dealt).withColumn("_entry", F.last("_entry", ignorenulls=True).over(by_time))
    now = F.col("_entry.valid_to").isNull() | (F.col("_at") < F.col("_entry.valid_to"))
    return last.where((F.col("_kind") == 1) & F.col("_entry").isNotNull() & now).select("url", F.col("_at").alias("fetched_at"), "key", "_entry.*")


RESULT = ("matched_key", "action", "category", "valid_from", "blocked")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (with url and fetched_at) and matched_key, action, category, valid_from of the deciding entry, and blocked."""
    carried = [c for c in captures.columns if c not in RESULT]
    plain, back = common.masked(captures.select(*[F.col(f"`{c}`") for c in carried]), "url", "fetched_at")
    active = common.cut(intervals(entries))
    one = plain.select("url", "fetched_at").where("url is not null and fetched_at is not null").distinct()
    keyed = common.cut(one.select("url", "fetched_at", F.explode(keys_of(F.col("url"))).alias("key")))
    met = as_of(keyed, active).where(F.col("action") != "none")
    best = F.max(F.struct(F.length("key").alias("_n"), F.col("key").alias("matched_key"), "action", "category", "valid_from"))
    verdict = met.groupBy("url", "fetched_at").agg(best.alias("_v")).select(F.col("url").alias("_url"), F.col("fetched_at").alias("_fetched"), "_v")
    got = plain.join(verdict, (F.col("url") == F.col("_url")) & (F.col("fetched_at") == F.col("_fetched")), "left")
    fields = [F.col(f"_v.{x}").alias(x) for x in RESULT[:-1]]
    return got.select(*back, *fields, F.coalesce(F.col("_v.action") == "block", F.lit(False)).alias("blocked"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def _day(n: Column) -> Column:
    return F.timestamp_add("DAY", n, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list made by rule from the hosts in pages: the tables have none."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", _number(F.col("host")))
    row = lambda when, key, day, action, category: F.when(when, F.struct(key.alias("key"), _day(day).alias("listed_at"), F.lit(action).alias("action"), F.lit(category).alias("category")))
    n, host = F.col("n"), F.col("host")
    entries = F.array_compact(
        F.array(
            row(F.contains(host, F.lit("cheap-pills")), host, F.lit(0), "block", "spam"),
            row(n % 3 == 0, host, n % 200, "block", "adult"),
            row(n % 6 == 0, host, n % 200 + 90, "none", "adult"),
            row(n % 2 == 0, F.concat(host, F.lit("/en")), n % 150 + 30, "allow", "reviewed"),
            row(n % 5 == 0, F.substring_index(host, ".", -3), F.lit(120), "block", "malware"),
            row(n % 5 == 0, F.substring_index(host, ".", -3), F.lit(200), "none", "malware"),
        )
    )
    return hosts.select(F.explode(entries).alias("e")).select("e.*").distinct()


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time; each gets one of the year 2024 by rule."""
    pages = common.table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", _day(_number(F.coalesce("url", F.lit(""))) % 366).alias("fetched_at"))
    return filter_urls(captures, dated_list(pages))


_N = "CAST('0x' || substr(md5({0}), 1, 6) AS INTEGER)"
_D = "(TIMESTAMP '2024-01-01' + to_days({0}))"
_SQL_HOST = f"lower(regexp_extract(coalesce(url, ''), '{HOST}', 1))"
ORACLE = f"""
WITH hosts AS (SELECT host, {_N.format("host")} AS n FROM (SELECT DISTINCT {_SQL_HOST} AS host FROM pages) WHERE host <> ''),
listed AS (
  SELECT host AS key, {_D.format("0")} AS listed_at, 'block' AS action, 'spam' AS category FROM hosts WHERE contains(host, 'cheap-pills')
  UNION SELECT host, {_D.format("n % 200")}, 'block', 'adult' FROM hosts WHERE n % 3 = 0
  UNION SELECT host, {_D.format("n % 200 + 90")}, 'none', 'adult' FROM hosts WHERE n % 6 = 0
  UNION SELECT host || '/en', {_D.format("n % 150 + 30")}, 'allow', 'reviewed' FROM hosts WHERE n % 2 = 0
  UNION SELECT array_to_string(string_split(host, '.')[-3:], '.'), {_D.format("120")}, 'block', 'malware' FROM hosts WHERE n % 5 = 0
  UNION SELECT array_to_string(string_split(host, '.')[-3:], '.'), {_D.format("200")}, 'none', 'malware' FROM hosts WHERE n % 5 = 0
),
last AS (SELECT key, listed_at, max({{'action': action, 'category': category}}) AS e FROM listed GROUP BY key, listed_at),
active AS (SELECT key, e.action AS action, e.category AS category, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY key ORDER BY listed_at) AS valid_to FROM last),
capture AS (
  SELECT row_number() OVER () AS r, page_id, url, {_D.format(_N.format("coalesce(url, '')") + " % 366")} AS fetched_at,
    {_SQL_HOST} AS host, regexp_extract(coalesce(url, ''), '{FIRST_SEGMENT}', 1) AS segment FROM pages
),
keyed AS (
  SELECT DISTINCT r, fetched_at, key FROM (
    SELECT r, fetched_at, array_to_string(string_split(host, '.')[i:], '.') AS key FROM capture, range(1, 20) t(i) WHERE host <> '' AND i <= greatest(len(string_split(host, '.')) - 1, 1)
    UNION ALL SELECT r, fetched_at, host || segment FROM capture WHERE host <> '' AND segment <> '')
),
best AS (
  SELECT r, max({{'n': length(key), 'matched_key': key, 'action': action, 'category': category, 'valid_from': valid_from}}) AS v
  FROM keyed JOIN active USING (key) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to) AND action <> 'none' GROUP BY r
)
SELECT page_id, url, fetched_at, v.matched_key AS matched_key, v.action AS action, v.category AS category, v.valid_from AS valid_from, coalesce(v.action = 'block', false) AS blocked
FROM capture LEFT JOIN best USING (r)
"""
