"""URL filtering against dated lists.

List entries are dated events: from ``day`` on, ``pattern`` is blocked or allowed
("block", "allow"), or the entry is withdrawn ("remove").  Per pattern the
events become validity intervals; a capture is judged by the entries active when
it was fetched.  A pattern is a host, which covers its subdomains, optionally
followed by a path prefix.  Of several active entries the most specific decides:
the longest host, then the longest path.

Entries are looked up for distinct hosts, not for captures: the suffixes of each host
meet the hosts of the list in an equi-join, where frequent suffixes ("com") meet on
the map side and what no entry names is dropped.  Every host then has the array of
its entries, each capture is joined with that of its host, and the as-of condition
and the path are checked within the array.  No task compares every capture with every
entry.  Nothing is broadcast but frequent suffixes, at most ``exact_dedup.COUNTERS``; a
host that very many captures share is split by adaptive execution.

Results for odd input:
* a capture with null or unparsable url, or null fetch time, matches nothing and
  passes; an empty host likewise;
* hosts are compared without regard to case, paths with;
* list events with null pattern, day or action, or an unknown action, are left out;
  several events of one pattern on one instant: "remove" loses to "allow", "allow"
  to "block"; repeated events count once;
* an interval holds from its day on, up to, not including, the next event's;
* ids of any type and size; repeated captures are judged one by one; very long urls
  count whole; an empty list passes everything; an empty capture table gives no rows;
  further columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick
from .exact_dedup import meet


def intervals(events: DataFrame) -> DataFrame:
    """(host, path, action, since, until) from (pattern, day, action); until is null for entries still active."""
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    e = pick(events, pattern="pattern", day="day", action="action").select(F.trim("pattern").alias("pattern"), F.col("day").cast("timestamp_ntz").alias("since"), rank.alias("rank"))
    # the host without regard to case, the path as it stands
    host = F.substring_index("pattern", "/", 1)
    e = e.withColumn("pattern", F.concat(F.lower(host), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)")))
    e = e.where("pattern <> '' and since is not null and rank is not null").groupBy("pattern", "since").agg(F.max("rank").alias("rank"))
    w = Window.partitionBy("pattern").orderBy("since")
    # repeated statements of what holds already don't cut the interval
    e = e.withColumn("was", F.lag("rank").over(w)).where("was is null or was <> rank")
    e = e.withColumn("until", F.lead("since").over(w)).where("rank > 0")
    cut = F.instr("pattern", "/")
    return e.select(
        F.when(cut > 0, F.substring("pattern", F.lit(1), cut - 1)).otherwise(F.col("pattern")).alias("entry_host"),
        F.when(cut > 0, F.expr("substring(pattern, instr(pattern, '/'))")).otherwise(F.lit("/")).alias("entry_path"),
        F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"),
        "since",
        "until",
    )


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    """Path without query and fragment; "/" if there is none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(p == "", "/").otherwise(p)


def judge(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(page_id, url, fetched, action, entry) per capture: the deciding entry and "block", "allow" or, without one, "pass"."""
    c = pick(captures, page_id=id_col, url=url_col, fetched=time_col).withColumn("fetched", F.col("fetched").cast("timestamp_ntz"))
    c = c.withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    parts = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(".", F.slice(parts, i, F.size(parts))))
    hosts = c.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes).alias("entry_host"))
    spans = intervals(events)
    # hosts with an entry, and all the entries of each
    listed = meet(hosts, spans.select("entry_host").distinct(), "entry_host")
    entry = F.struct(F.length("entry_host").alias("h"), F.length("entry_path").alias("p"), "action", F.concat("entry_host", "entry_path").alias("entry"), F.col("entry_path").alias("path"), "since", "until")
    of_host = listed.join(spans, "entry_host").groupBy("host").agg(F.collect_list(entry).alias("entries"))
    at, path = F.col("fetched"), path_of(F.col("url"))
    active = F.filter("entries", lambda e: (e["since"] <= at) & (e["until"].isNull() | (at < e["until"])) & path.startswith(e["path"]))
    # the longest host, then the longest path: only one entry has both
    return c.join(of_host, "host", "left").withColumn("best", F.array_max(active)).select(
        "page_id", "url", "fetched", F.coalesce("best.action", F.lit("pass")).alias("action"), F.col("best.entry").alias("entry")
    )


#: The dated list of the registered query: (pattern, day, action).
LIST = [
    ("casino-win.example.com", "2023-02-01", "block"),
    ("casino-win.example.com", "2023-06-15", "remove"),
    ("casino-win.example.com", "2023-09-01", "block"),
    ("ads-track.example.com", "2023-03-10", "block"),
    ("ads-track.example.com", "2023-03-10", "remove"),
    ("ads-track.example.com", "2023-11-20", "remove"),
    ("m.ads-track.example.com", "2023-05-01", "allow"),
    ("m.ads-track.example.com", "2023-08-01", "remove"),
    ("free-bets.example.com", "2022-12-01", "block"),
    ("free-bets.example.com", "2023-04-01", "block"),
    ("example.net", "2023-07-01", "block"),
    ("example.net", "2023-07-08", "remove"),
    ("tionble.example.org/en", "2023-01-20", "block"),
    ("tionble.example.org/en", "2023-10-01", "allow"),
    ("blog.tionsh.example.com/fr/", "2023-02-14", "block"),
    ("blog.tionsh.example.com", "2023-02-10", "allow"),
    ("blog.tionsh.example.com/fr/", "2023-12-24", "remove"),
    ("ththth.example.net", "2023-07-02", "allow"),
    ("never-seen.example.org", "2023-01-01", "block"),
]


def captured(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time: the tables have none, so it is spread over 2023 by id, by the hour."""
    hours = "cast(pmod(pmod(page_id, 8760) * 7919, 8760) as int)"
    return pick(pages, page_id="page_id", url="url").withColumn("fetched", F.expr(f"timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(0, {hours}, 0, 0)"))


def oracle(events: list[tuple[str, str, str]] = LIST) -> str:
    """DuckDB SQL of ``judge`` over ``captured``."""
    values = ", ".join(f"('{p}', TIMESTAMP '{d} 00:00:00', {dict(block=2, allow=1, remove=0)[a]})" for p, d, a in events)
    return f"""
    WITH ev(pattern, since, rank) AS (VALUES {values}),
    one AS (SELECT pattern, since, max(rank) AS rank FROM ev GROUP BY ALL),
    span AS (SELECT pattern, since, rank, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM one),
    entry AS (SELECT *, CASE WHEN contains(pattern, '/') THEN split_part(pattern, '/', 1) ELSE pattern END AS eh,
                     CASE WHEN contains(pattern, '/') THEN substr(pattern, instr(pattern, '/')) ELSE '/' END AS ep FROM span WHERE rank > 0),
    cap AS (SELECT page_id, url, TIMESTAMP '2023-01-01 00:00:00' + to_hours(((page_id * 7919) % 8760)::INT) AS fetched,
                   lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
                   CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*(/[^?#]*)?', 1) END AS path FROM pages),
    hit AS (SELECT c.page_id, c.url, e.rank, e.eh || e.ep AS entry,
                   row_number() OVER (PARTITION BY c.page_id ORDER BY length(e.eh) DESC, length(e.ep) DESC) AS nth
            FROM cap c JOIN entry e ON (c.host = e.eh OR ends_with(c.host, '.' || e.eh)) AND starts_with(c.path, e.ep)
             AND e.since <= c.fetched AND (e.until IS NULL OR c.fetched < e.until))
    SELECT c.page_id AS page_id, c.url AS url, c.fetched AS fetched,
           CASE h.rank WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'pass' END AS action, h.entry AS entry
    FROM cap c LEFT JOIN hit h ON c.page_id = h.page_id AND h.nth = 1
    """
