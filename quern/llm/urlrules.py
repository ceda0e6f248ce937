"""URL rules by a sort-merge range join over reversed hosts; DataFrame operations only.

A reversed host (``com.example.www``) turns a rule's host and all its subdomains into one interval
of keys, and such intervals are nested or apart. Rule starts, rule ends and urls are put in one
order of keys; sweeping along it, the rules that are open at a point are a stack, which changes at
starts and ends only. Each url meets its stack, and the longest rule in it whose path fits wins.

The order is cut into ranges of keys, and ranges with many urls are cut again by a salt, so a host
with a third of all urls is no single task. Every cut gets the rules' events of its range and the
stack that is open where it begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Behind every character of a host: with it behind a label, all subdomains come before the end.
LAST = "\U0010ffff"
#: Ranges of keys; urls that one window holds at most on average are MOST, or what leaves WINDOWS windows for each partition of
#: a shuffle if that is more (so copies of rules grow with the cluster, not with the urls).
RANGES, MOST, WINDOWS = 256, 2000, 8


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    rest = F.when(F.col(url).contains("://"), F.regexp_replace(F.col(url), r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each with a dot behind it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _number(key: Column) -> Column:
    """The first seven bytes of a key as a number in the same order."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(key, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(0).cast("long"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url) under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's path; of those
    that fit the longest (host and path together) wins, then the longer host, then the smaller verdict.
    rule is host and path of that rule, null if none fits; verdict then is ``default``. A null url has
    an empty host and path, which no rule with a host fits. Repeated rows are judged each; an empty
    table gives an empty one; other columns go.
    """
    host, path = host_and_path()
    points = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("key", reversed_host(F.col("host")))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))
    # All rules of one host, then with those of its parents: the stack that opens with the host.
    hosts = rules.filter("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct().groupBy("host").agg(F.sort_array(F.collect_list(rule)).alias("own")).withColumn("key", reversed_host(F.col("host")))
    labels = F.split("key", r"\.")
    lines = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("above"))
    above = hosts.select(F.col("key").alias("above"), "own")
    stacks = lines.join(above, "above").groupBy("key").agg(F.flatten(F.sort_array(F.collect_list("own"))).alias("stack"), F.max(F.when(F.col("above") != F.col("key"), F.col("above"))).alias("parent"))
    # When a host's interval ends, its nearest parent's stack is open again.
    parents = stacks.select(F.col("key").alias("parent"), F.col("stack").alias("outer"))
    empty = F.slice("stack", 1, 0)
    stacks = stacks.join(parents, "parent", "left").select("key", "stack", F.coalesce("outer", empty).alias("outer"))
    # Ends of inner intervals come before those of outer ones: the longer key first.
    start = F.struct(F.col("key").alias("key"), F.lit(0).alias("kind"), F.length("key").alias("depth"))
    end = F.struct(F.concat("key", F.lit(LAST)).alias("key"), F.lit(2).alias("kind"), (-F.length("key")).alias("depth"))
    events = stacks.select(F.explode(F.array(F.struct(start.alias("at"), F.col("stack").alias("open")), F.struct(end.alias("at"), F.col("outer").alias("open")))).alias("e")).select("e.at", "e.open")

    numbered = points.withColumn("n", _number(F.col("key")))
    cuts = F.array_distinct(F.coalesce(F.percentile_approx("n", [k / RANGES for k in range(1, RANGES)], 10_000), F.array().cast("array<bigint>")))
    cut, n_urls = numbered.agg(cuts.alias("cuts"), F.count("*")).first()  # at most RANGES numbers
    most = max(MOST, n_urls // (WINDOWS * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    tree = F.array(*[F.lit(x) for x in cut]) if cut else F.array().cast("array<bigint>")
    # A key equal to a cut lies in the range that the cut begins.
    of = lambda n: F.size(F.filter(tree, lambda x: x <= n))
    # Written, as it is read twice (and the optimiser fails on unions of such derived columns).
    ranged = written(numbered.select("page_id", "host", "path", "key", of(F.col("n")).alias("range")), "urls")
    sizes = ranged.groupBy("range").agg((F.floor((F.count("*") - 1) / most) + 1).cast("int").alias("salts"))  # at most RANGES rows
    events = events.withColumn("range", of(_number(F.col("at.key"))))
    carried = events.groupBy("range").agg(F.max_by("open", "at").alias("open"))  # at most RANGES rows
    begins = sizes.select("range", "salts", F.lit(None).cast(carried.schema["open"].dataType).alias("open")).unionByName(carried.select("range", F.lit(None).cast("int").alias("salts"), "open"))
    before = Window.orderBy("range")
    begins = begins.groupBy("range").agg(F.max("salts").alias("salts"), F.first("open", ignorenulls=True).alias("open"))
    begins = begins.withColumn("carry", F.last("open", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))).filter("salts is not null")

    least = F.struct(F.lit("").alias("key"), F.lit(-1).alias("kind"), F.lit(0).alias("depth"))
    sent = begins.select("range", "salts", least.alias("at"), F.col("carry").alias("open"))
    sent = sent.unionByName(events.join(begins.select("range", "salts"), "range").select("range", "salts", "at", "open"))
    sent = sent.select("range", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "at", "open")
    point = F.struct(F.col("key").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("depth"))
    asked = ranged.join(F.broadcast(begins.select("range", "salts")), "range").select("range", F.pmod(F.xxhash64("page_id", "path", "key"), F.col("salts")).cast("int").alias("salt"), point.alias("at"), F.lit(None).cast(carried.schema["open"].dataType).alias("open"), "page_id", "host", "path")
    both = sent.unionByName(asked, allowMissingColumns=True)
    swept = both.withColumn("open", F.last("open", ignorenulls=True).over(Window.partitionBy("range", "salt").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("at.kind") == 1)
    fitting = F.filter(F.coalesce("open", F.array().cast(carried.schema["open"].dataType)), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
