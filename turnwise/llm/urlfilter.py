"""URL filters by a temporal list join (operator 1).

A list is a table of dated entries (pattern, action, effective date). Patterns
are host names, which cover their subdomains, or host/path prefixes; actions are
``block``, ``allow`` and ``remove`` (which ends the entry before). The entries of a
pattern become validity intervals: from an entry's date, included, to the date
of the next one, excluded. A capture is met with the entries that were valid
when it was fetched:

1. the URL is normalised and gives its possible patterns, a handful of host
   suffixes and path prefixes;
2. these are joined with the intervals on the pattern, as-of the fetch time.
   The list is broadcast if it has at most ``broadcast_rows`` rows; a larger one
   is joined by a shuffle whose hot patterns are salted: a capture goes to one
   of ``salts`` parts, the intervals of a pattern to all;
3. the longest pattern decides; on a tie ``allow`` wins, then ``block``.

Defined results: a capture without a URL, host or fetch time meets no entry and
is kept; entries without a pattern or date are ignored; entries of one pattern
and date count in the order allow, block, remove, of which the last one holds;
repeated captures are decided one by one; all their columns are kept, and new
columns never take the name of one; an empty table or list is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import fresh
from turnwise.session import table

_RANK = {"allow": 1, "block": 2, "remove": 3}


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot."""
    rest = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), r"^[^@]*@", "")
    return F.regexp_replace(F.regexp_replace(rest, r":\d*$", ""), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without query and fragment, without its final slash."""
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1), r"/+$", "")


def patterns_of(url: Column, depth: int | Column = 3) -> Column:
    """Host suffixes, longest first, and the host with up to ``depth`` path parts."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    some = F.least(F.size(parts), F.lit(depth) if isinstance(depth, int) else depth)
    prefixes = F.when(some > 0, F.transform(F.sequence(F.lit(1), F.greatest(some, F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (open: null) of (pattern, action, effective)."""
    rank = F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv])
    host = F.substring_index("pattern", "/", 1)  # case matters in a path
    own = entries.select(F.concat(F.lower(host), F.substr("pattern", F.length(host) + F.lit(1))).alias("pattern"), "action", "effective").where("pattern IS NOT NULL AND effective IS NOT NULL").where(F.col("action").isin(list(_RANK)))
    last = own.groupBy("pattern", "effective").agg(F.max_by("action", F.try_element_at(rank, F.col("action"))).alias("action"))
    order = Window.partitionBy("pattern").orderBy("effective")
    spans = last.select("pattern", "action", F.col("effective").alias("valid_from"), F.lead("effective").over(order).alias("valid_to"))
    return spans.where("action <> 'remove'")


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched", broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """``captures`` with ``action`` (null: no entry), ``pattern`` and ``kept`` added.

    Where ``captures`` has a column of such a name, the new one gets a number at its end.
    """
    spans = intervals(entries)
    u, f, p, t, s, b = (fresh(captures, c) for c in ("_url", "_fetched", "_pattern", "_salt", "_part", "_best"))
    action, pattern, kept = (fresh(captures, c) for c in ("action", "pattern", "kept"))
    small = spans.limit(broadcast_rows + 1).count() <= broadcast_rows
    depth = spans.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0  # no entry has more path parts
    # the captures of one url and time are decided once and by one key
    keyed = captures.select(F.col(url).alias(u), F.col(fetched).alias(f)).where(F.col(f).isNotNull() & F.col(u).isNotNull()).distinct()
    asked = keyed.select(u, f, F.explode(patterns_of(F.col(u), depth)).alias(p))
    inside = lambda x: (F.col(f) >= x["valid_from"]) & (x["valid_to"].isNull() | (F.col(f) < x["valid_to"]))
    if small:
        side = F.broadcast(spans)
        met = asked.join(side, (F.col(p) == spans["pattern"]) & inside(spans))
    else:
        salted = spans.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = asked.withColumn(t, F.pmod(F.xxhash64(u, f), F.lit(salts)).cast("int"))
        met = asked.join(salted, (F.col(p) == salted["pattern"]) & (F.col(t) == salted[s]) & inside(salted))
    best = met.groupBy(u, f).agg(F.max(F.struct(F.length("pattern").alias("n"), F.when(F.col("action") == "allow", 1).otherwise(0).alias("a"), "pattern", "action")).alias(b))
    verdict = best.select(u, f, F.col(f"{b}.action").alias(action), F.col(f"{b}.pattern").alias(pattern))
    out = captures.join(verdict, (captures[url] == verdict[u]) & (captures[fetched] == verdict[f]), "left").drop(u, f)
    return out.withColumn(kept, F.coalesce(F.col(action) != "block", F.lit(True)))


def sample_entries(spark: SparkSession) -> DataFrame:
    """A dated list for the query; fixed values, in the form of a public blocklist's history."""
    rows = [
        ("spam-farm.example.org", "block", "2023-11-01"), ("www.cheap-pills.example.com", "block", "2023-06-15"), ("www.cheap-pills.example.com", "remove", "2024-02-01"),
        ("www.cheap-pills.example.com", "block", "2024-03-10"), ("example.net", "block", "2024-02-20"), ("example.net", "remove", "2024-04-01"),
        ("tionsh.example.net", "allow", "2024-02-25"), ("blog.tionsh.example.net", "block", "2024-01-10"), ("blog.tionsh.example.net", "allow", "2024-02-10"),
        ("ththth.example.net", "block", "2024-03-01"), ("m.ththth.example.net/en", "allow", "2024-03-15"), ("blog.ththan.example.net/de", "block", "2024-01-20"),
        ("blog.ththan.example.net/en/1", "block", "2024-01-01"), ("tiontion.example.com", "block", "2024-01-15"), ("tiontion.example.com", "allow", "2024-03-05"),
        ("casino.example.com", "block", "2024-01-01"), ("example.org", "block", "2024-04-10"), ("thther.example.org", "allow", "2024-04-10"),
    ]
    values = ", ".join(f"('{p}', '{a}', date '{d}')" for p, a, d in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(pattern, action, effective)")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the dated list; a page's fetch day follows from its id, since the table has none."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr("date_add(date '2024-01-01', cast(page_id % 120 as int))")
    out = filter_urls(pages.withColumn("fetched", fetched), sample_entries(spark))
    return out.select("page_id", F.col("fetched").cast("string").alias("fetched"), "action", "pattern", "kept")


SQL = r"""
WITH e(pattern, action, effective) AS (VALUES
  ('spam-farm.example.org', 'block', DATE '2023-11-01'), ('www.cheap-pills.example.com', 'block', DATE '2023-06-15'), ('www.cheap-pills.example.com', 'remove', DATE '2024-02-01'),
  ('www.cheap-pills.example.com', 'block', DATE '2024-03-10'), ('example.net', 'block', DATE '2024-02-20'), ('example.net', 'remove', DATE '2024-04-01'),
  ('tionsh.example.net', 'allow', DATE '2024-02-25'), ('blog.tionsh.example.net', 'block', DATE '2024-01-10'), ('blog.tionsh.example.net', 'allow', DATE '2024-02-10'),
  ('ththth.example.net', 'block', DATE '2024-03-01'), ('m.ththth.example.net/en', 'allow', DATE '2024-03-15'), ('blog.ththan.example.net/de', 'block', DATE '2024-01-20'),
  ('blog.ththan.example.net/en/1', 'block', DATE '2024-01-01'), ('tiontion.example.com', 'block', DATE '2024-01-15'), ('tiontion.example.com', 'allow', DATE '2024-03-05'),
  ('casino.example.com', 'block', DATE '2024-01-01'), ('example.org', 'block', DATE '2024-04-10'), ('thther.example.org', 'allow', DATE '2024-04-10')),
i AS (SELECT pattern, action, effective AS f, lead(effective) OVER (PARTITION BY pattern ORDER BY effective) AS t FROM e),
p AS (SELECT page_id, DATE '2024-01-01' + (page_id % 120)::INT AS fetched, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)) AS h,
             regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1), '/+$', '') AS path FROM pages),
m AS (SELECT p.page_id, i.pattern, i.action, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.pattern) DESC, i.pattern DESC) AS k
      FROM p JOIN i ON p.fetched >= i.f AND (i.t IS NULL OR p.fetched < i.t) AND i.action <> 'remove'
       AND (p.h = i.pattern OR ends_with(p.h, '.' || i.pattern) OR starts_with(p.h || p.path || '/', i.pattern || '/')))
SELECT p.page_id, p.fetched::VARCHAR AS fetched, m.action, m.pattern, coalesce(m.action <> 'block', true) AS kept FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""
