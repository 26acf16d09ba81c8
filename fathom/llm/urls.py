"""URL filtering against dated lists by a temporal (as-of) join; DataFrame functions only.

A list is a log of entries: from ``effective_at`` on, ``pattern`` is added to or removed from a list. Per
(list, action, kind, pattern) the log becomes validity intervals [valid_from, valid_to). A capture asks for
its exact URL, its URL's path prefixes, its host and the host's parent domains, and every entry whose
interval holds the fetch time applies. Among these the most specific decides (url, prefix, host, domain; the
longest pattern; block before allow).

Every distinct (url, fetch time) is evaluated once. The as-of join is an equi-join on the pattern with the
interval as a further condition, so a hot host or a hot pattern is split by Spark's skew handling; no
window ever runs over captures. Entries and captures may both be of any size.

Defined results: a null URL or fetch time matches nothing and is kept; of entries of one pattern with one
time the removal wins; a removal without an addition has no effect; intervals without an end are open;
repeated captures get a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Specificity of what a pattern can name, most specific first.
KINDS = ("url", "prefix", "host", "domain")

ENTRY_COLUMNS = "list string, action string, kind string, pattern string, effective_at timestamp, listed boolean"


def scheme_less(url: Column) -> Column:
    """The URL without scheme, user, port, fragment, in lower case up to the path."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"#.*$", "")
    authority = F.regexp_extract(rest, r"^[^/?]*", 0)
    tail = F.substring(rest, F.length(authority) + 1, F.length(rest))
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    return F.concat(host, tail)


def host_of(url: Column) -> Column:
    return F.regexp_extract(scheme_less(url), r"^[^/?]*", 0)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of a log of entries: list, action, kind, pattern, valid_from, valid_to (null: open)."""
    key = ["list", "action", "kind", "pattern"]
    states = entries.where("pattern IS NOT NULL AND effective_at IS NOT NULL").groupBy(*key, "effective_at").agg(F.min(F.coalesce("listed", F.lit(False))).alias("listed"))
    order = Window.partitionBy(*key).orderBy("effective_at")
    changes = states.withColumn("before", F.lag("listed", 1, False).over(order)).where("listed <> before")
    spans = changes.withColumn("valid_to", F.lead("effective_at").over(order)).where("listed")
    return spans.select(*key, F.col("effective_at").alias("valid_from"), "valid_to")


def patterns_of(url: Column) -> Column:
    """array<struct<kind, pattern>> of all patterns that would match a URL."""
    flat = scheme_less(url)
    host = F.regexp_extract(flat, r"^[^/?]*", 0)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    # parent domains of two labels and more, the host itself included
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.regexp_extract(flat, r"^[^/?]*([^?]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    depth = F.size(parts)
    prefixes = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    named = lambda kind, column: F.transform(column, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("pattern")))
    none = F.array().cast("array<struct<kind: string, pattern: string>>")
    return F.concat(named("url", F.array(flat)), F.coalesce(named("prefix", prefixes), none), named("host", F.array(host)), named("domain", domains))


def _rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(url, fetched_at) once each with n_active, and list, action, kind, pattern of the deciding entry."""
    asked = captures.select(F.col("url").cast("string").alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at")).where("url IS NOT NULL AND fetched_at IS NOT NULL")
    # so many partitions and no fewer: small rows, but taking URLs apart is work
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(n, "url", "fetched_at").dropDuplicates()
    keys = asked.select("url", "fetched_at", F.explode(F.array_distinct(patterns_of(F.col("url")))).alias("k")).select("url", "fetched_at", "k.kind", "k.pattern")
    active = keys.join(intervals(entries), ["kind", "pattern"]).where("fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)")
    order = F.struct(_rank(F.col("kind")).alias("rank"), (-F.length("pattern")).alias("shorter"), (F.col("action") != "block").alias("allows"), "list", "action", "kind", "pattern", "valid_from")
    return active.groupBy("url", "fetched_at").agg(F.count(F.lit(1)).alias("n_active"), F.min(order).alias("by")).select("url", "fetched_at", "n_active", "by.list", "by.action", "by.kind", "by.pattern", "by.valid_from")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The captures with all their columns but those of the result, then n_active, list, action, kind, pattern, valid_from, kept."""
    found = verdicts(captures, entries)
    added = ["n_active", "list", "action", "kind", "pattern", "valid_from"]
    own = [c for c in captures.columns if c.lower() not in {*added, "kept"}]
    left = captures.select(*own).alias("c")
    match = (F.col("c.url").cast("string") == F.col("v.url")) & (F.col("c.fetched_at").cast("timestamp") == F.col("v.fetched_at"))
    joined = left.join(found.alias("v"), match, "left")
    kept = F.coalesce(F.col("v.action") != "block", F.lit(True)).alias("kept")
    return joined.select(*(F.col(f"c.`{c}`") for c in own), F.coalesce("v.n_active", F.lit(0)).cast("long").alias("n_active"), *(F.col(f"v.{c}") for c in added[1:]), kept)


# ---- the query: captures of `pages`, with lists derived from their hosts by rule ------------------

#: Fetch times are spread over 2024 by the page's number; list entries by hashes of hosts and sites. The same rule is in ORACLE.
START = "2024-01-01 00:00:00"


def _nibbles(text: Column, at: int, n: int) -> Column:
    """n hex digits of the text's MD5 from digit ``at`` (from 1), as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, n), 16, 10).cast("long")


def _day(offset: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + offset * 86400)


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch time: 7919 minutes a page number apart, within 366 days of START."""
    page = F.col("page_id").cast("long")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.pmod(page * 7919, F.lit(527040)) * 60)
    return pages.select(page.alias("page_id"), F.col("url").cast("string").alias("url"), at.alias("fetched_at"))


def derived_lists(pages: DataFrame) -> DataFrame:
    """Dated entries by rule: a quarter of the hosts blocked and most of these released later, an eighth of
    the sites (last two labels) blocked, a sixteenth of the first path levels allowed."""
    url = F.col("url").cast("string")
    # a host or site may have a third of all pages, so each is reduced to one row first
    hosts = pages.where("url IS NOT NULL").select(host_of(url).alias("host"), F.regexp_extract(scheme_less(url), r"^[^/?]*/[^/?]+", 0).alias("level")).distinct()
    hosts = Scratch(pages.sparkSession, "urls").keep(hosts, "hosts")  # read by each branch; the pages once
    host = hosts.select("host").distinct().where("host <> ''")
    h = F.col("host")
    row = lambda name, action, kind, pattern, at, listed: (F.lit(name).alias("list"), F.lit(action).alias("action"), F.lit(kind).alias("kind"), pattern.alias("pattern"), _day(at).alias("effective_at"), F.lit(listed).alias("listed"))
    begin = F.pmod(_nibbles(h, 3, 4), F.lit(300))
    blocked = host.where(_nibbles(h, 1, 2) < 64)
    site = host.select(F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2)).alias("site")).where(F.size(F.split("site", r"\.")) == 2).distinct()
    s, level = F.col("site"), F.col("level")
    levels = hosts.select("level").distinct().where("level <> ''")
    return (
        blocked.select(*row("hosts", "block", "host", h, begin, True))
        .union(blocked.where(_nibbles(h, 7, 1) < 12).select(*row("hosts", "block", "host", h, begin + 1 + _nibbles(h, 8, 2), False)))
        .union(site.where(_nibbles(s, 1, 2) < 32).select(*row("sites", "block", "domain", s, F.pmod(_nibbles(s, 3, 4), F.lit(366)), True)))
        .union(levels.where(_nibbles(level, 1, 2) < 16).select(*row("levels", "allow", "prefix", level, F.pmod(_nibbles(level, 3, 4), F.lit(200)), True)))
    )


ORACLE = r"""
WITH flat AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(((page_id * 7919) % 527040)::BIGINT) AS fetched_at,
         regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM pages
), cut AS (
  SELECT *, regexp_extract(rest, '^[^/?]*', 0) AS authority FROM flat
), c AS (
  SELECT page_id, url, fetched_at, regexp_replace(regexp_replace(lower(authority), '^.*@', ''), ':[0-9]*$', '') AS host,
         substr(rest, length(authority) + 1) AS tail
  FROM cut
), h AS (SELECT DISTINCT host FROM c WHERE host <> ''
), l AS (SELECT DISTINCT regexp_extract(host || tail, '^[^/?]*/[^/?]+', 0) AS level FROM c WHERE regexp_extract(host || tail, '^[^/?]*/[^/?]+', 0) <> ''
), s AS (SELECT DISTINCT regexp_extract(host, '[^.]*\.[^.]*$', 0) AS site FROM h WHERE host LIKE '%.%'
), e AS (
  SELECT 'hosts' AS list, 'block' AS action, 'host' AS kind, 2 AS rank, host AS pattern, ('0x' || substr(md5(host), 3, 4))::BIGINT % 300 AS d1,
         CASE WHEN ('0x' || substr(md5(host), 7, 1))::BIGINT < 12 THEN ('0x' || substr(md5(host), 3, 4))::BIGINT % 300 + 1 + ('0x' || substr(md5(host), 8, 2))::BIGINT END AS d2
  FROM h WHERE ('0x' || substr(md5(host), 1, 2))::BIGINT < 64
  UNION ALL
  SELECT 'sites', 'block', 'domain', 3, site, ('0x' || substr(md5(site), 3, 4))::BIGINT % 366, NULL FROM s WHERE ('0x' || substr(md5(site), 1, 2))::BIGINT < 32
  UNION ALL
  SELECT 'levels', 'allow', 'prefix', 1, level, ('0x' || substr(md5(level), 3, 4))::BIGINT % 200, NULL FROM l WHERE ('0x' || substr(md5(level), 1, 2))::BIGINT < 16
), spans AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_days(d1::INTEGER) AS valid_from, TIMESTAMP '2024-01-01 00:00:00' + to_days(d2::INTEGER) AS valid_to FROM e
), active AS (
  SELECT c.page_id, c.url, c.fetched_at, s.* FROM c JOIN spans s ON (
      (s.kind = 'host' AND s.pattern = c.host)
      OR (s.kind = 'domain' AND s.pattern = regexp_extract(c.host, '[^.]*\.[^.]*$', 0))
      OR (s.kind = 'prefix' AND s.pattern = regexp_extract(c.host || c.tail, '^[^/?]*/[^/?]+', 0)))
  WHERE c.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR c.fetched_at < s.valid_to)
), first AS (
  SELECT *, count(*) OVER (PARTITION BY page_id, url, fetched_at) AS n, row_number() OVER (PARTITION BY page_id, url, fetched_at ORDER BY rank, list) AS k FROM active
)
SELECT c.page_id, c.url, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, coalesce(f.n, 0)::BIGINT AS n_active, f.list, f.action, f.kind, f.pattern,
       strftime(f.valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(f.action <> 'block', true) AS kept
FROM c LEFT JOIN first f ON f.page_id = c.page_id AND f.url = c.url AND f.fetched_at = c.fetched_at AND f.k = 1
"""
