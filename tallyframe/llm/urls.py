"""URL filters as a temporal list join, in DataFrame functions alone.

A list is a table of dated entries. The entries of one pattern become validity
intervals, and an as-of join finds for every capture the entries that were
active when it was fetched, so a page is judged by the list of its time and not
by today's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import col

# What an entry does; of entries of one pattern and day the later one here holds.
ACTIONS = ("delist", "allow", "block")
KINDS = ("domain", "prefix")
AUTHORITY = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where the text has none."""
    return F.rtrim(F.lower(F.regexp_extract(url, f"{AUTHORITY}([^/?#:]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def _keys(host: Column, path: Column, depths: list[int]) -> Column:
    """Every pattern that may cover a URL: its host's suffixes, and its host with the first parts of the path.

    ``depths`` are the numbers of path parts that any pattern has; no other beginnings are built.
    """
    labels = F.split(host, "\\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    parts = F.slice(F.filter(F.split(path, "/"), lambda p: p != ""), 1, max(depths, default=0))
    built = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda n: n <= F.size(parts))
    prefixes = F.transform(
        built,
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern")),
    )
    return F.when(host != "", F.concat(domains, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals ``kind``, ``pattern``, ``action``, ``valid_from``, ``valid_to`` (exclusive, null while open).

    ``entries`` has ``kind`` (domain, prefix), ``pattern``, ``action`` (block,
    allow, delist) and ``dated`` (a date). An entry holds until the next one
    of its pattern; a delisting ends it. Entries with a null or an unknown
    kind or action are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    known = entries.where(F.col("kind").isin(*KINDS) & F.col("action").isin(*ACTIONS) & F.col("pattern").isNotNull() & F.col("dated").isNotNull())
    daily = known.groupBy("kind", "pattern", "dated").agg(F.max_by("action", rank).alias("action"))
    following = F.expr("lead(dated) over (partition by kind, pattern order by dated)")
    held = daily.withColumn("valid_to", following).where("action <> 'delist'")
    return held.select("kind", "pattern", "action", F.col("dated").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """All columns of ``captures`` with ``verdict``, ``decided_by`` and ``n_active``.

    ``n_active`` counts the entries active on the day of the capture that
    cover its URL: a domain covers its subdomains, a prefix its host and the
    paths below it. The most specific decides: a prefix before a domain, the
    longer before the shorter. ``verdict`` is ``block`` or ``allow``;
    ``decided_by`` is the deciding pattern, null where none is active. A null
    URL or time, and a URL without a host, has no active entry and is allowed.
    Each row keeps its place, repeated ones too. Columns of the input with an
    added name, in any case, are replaced. An empty table gives no rows, an
    empty list allows everything.

    Equal URLs of one day are judged once. Intervals are cut by month and
    joined on pattern and month, so one capture meets at most the 31 intervals
    of a pattern and month however often the pattern changed; the join is one
    that adaptive execution may split where a host is hot. Of a path only the
    beginnings with as many parts as some pattern has are built, so a URL of very
    many parts costs no more than its length times the few depths of the list; the
    distinct depths, numbers below the parts of the longest pattern, reach the driver.
    """
    added = ("verdict", "decided_by", "n_active")
    names = [c for c in captures.columns if c.lower() not in added]
    rows = captures.select(*(col(captures, c).alias(f"_{i}") for i, c in enumerate(names)))
    url, fetched = F.col(f"_{names.index(url_col)}"), F.col(f"_{names.index(fetched_col)}")
    rows = rows.withColumn("_day", fetched.cast("date"))
    targets = rows.select(url.alias("u"), F.col("_day").alias("day")).where("u is not null and day is not null").distinct()
    first, last = targets.agg(F.min("day"), F.max("day")).first()
    held = validity(entries)
    depth = F.size(F.split("pattern", "/")) - 1
    depths = sorted(r["n"] for r in held.where("kind = 'prefix'").select(depth.alias("n")).where("n > 0").distinct().collect())

    keyed = targets.withColumn("key", F.explode(_keys(host_of(F.col("u")), path_of(F.col("u")), depths)))
    keyed = keyed.select("u", "day", F.col("key.kind").alias("kind"), F.col("key.pattern").alias("pattern"), F.trunc("day", "month").alias("month"))
    begin = F.greatest("valid_from", F.lit(first).cast(T.DateType()))
    end = F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast(T.DateType())), F.lit(last).cast(T.DateType()))
    months = F.when(begin <= end, F.sequence(F.trunc(begin, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    cut = held.withColumn("month", F.explode(months)).select(
        F.col("kind").alias("k"), F.col("pattern").alias("p"), F.col("month").alias("m"), "action", "valid_from", "valid_to"
    )
    same = (F.col("pattern") == F.col("p")) & (F.col("month") == F.col("m")) & (F.col("kind") == F.col("k"))
    then = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    hits = keyed.join(cut, same & then)
    rank = F.struct(F.col("kind") == "prefix", F.length("pattern"))
    judged = hits.groupBy("u", "day").agg(F.max(F.struct(rank, "action", "pattern")).alias("best"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(judged, (url == F.col("u")) & (F.col("_day") == F.col("day")), "left")
    return joined.select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(names)),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
        F.col("best.pattern").alias("decided_by"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"),
    )
