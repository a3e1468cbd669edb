"""URL filter by a sort-merge range join, in DataFrame operations only.

A host's labels in reverse, each ended by a sign that sorts below all others,
make a key; a rule on a host is then the interval of keys that begin with the
rule's key, and a rule's path the interval of paths that begin with it. Such
intervals are nested or apart, so one sweep over sorted starts and urls keeps a
stack: each start carries the intervals that hold it, itself included, and what
holds a url is among the stack of the last start before it.

Two sweeps: by host key, which gives a url the hosts that have rules for it (at
most as many as it has labels), and by (host, path) for each of these, which
gives the longest path. Sorted rows are dealt by ranges, urls of one key being
spread by a hash, and the last start of the ranges before is carried into each;
so neither the rules of a host nor the urls of a host meet in one task.

Defined cases: a null url or one without `://` has an empty host and path and
the default verdict; an empty host fits no rule; a rule without a path has an
empty one, which any path begins with; of rules with equal host and path `block`
wins, of equal length the longer host; repeated rows are judged each by itself;
an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import LOWER, UPPER, cut

#: Rules: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    until = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.regexp_extract(until, r"(?s)^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(until, F.length(host) + 1, F.length(until))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by U+0001; lower signs in a host become U+0003."""
    labels = F.split(F.translate(host, "\x00\x01\x02", "\x03\x03\x03"), r"\.", -1)
    return F.concat(F.array_join(F.reverse(labels), "\x01"), F.lit("\x01"))


def host_starts(rules: DataFrame) -> DataFrame:
    """(key, stack): where the interval of a host with rules starts, and the hosts whose intervals hold it, found by an equal join on its ancestors."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    up = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("above"))
    above = up.join(hosts.select(F.col("host").alias("above")), "above")
    return above.groupBy("host").agg(F.sort_array(F.collect_list("above")).alias("stack")).select(host_key(F.col("host")).alias("key"), "stack")


def path_starts(rules: DataFrame) -> DataFrame:
    """(rule_host, key, stack): where the interval of a rule's path starts, and the rules of its host whose intervals hold it."""
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "host", "path", "verdict")
    own = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("prefix"), rule.alias("rule"))
    ways = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("key"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    ways = ways.withColumn("prefix", F.substring(F.col("key"), F.lit(1), F.col("n"))).drop("n")
    return ways.join(own, ["rule_host", "prefix"]).groupBy("rule_host", "key").agg(F.collect_list("rule").alias("stack"))


def swept(rows: DataFrame, starts: DataFrame, order: list[str]) -> DataFrame:
    """rows with `stack`: that of the last start at or before each row in `order` (null: there is none); row_no spreads rows of one key."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = rows.withColumn("__rank", F.lit(1)).unionByName(starts.withColumn("__rank", F.lit(0)), allowMissingColumns=True)
    spread = F.when(F.col("__rank") == 1, F.xxhash64("row_no"))
    dealt = cut(both.withColumn("__spread", spread).repartitionByRange(n, *order, "__rank", "__spread").drop("__spread").withColumn("__range", F.spark_partition_id()), "ranges")
    last = dealt.filter("__rank = 0").groupBy("__range").agg(F.max_by("stack", F.struct(*order)).alias("__last"))
    # one row a range: n rows at most, in the window and in the broadcast
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("__range")).join(last, "__range", "left")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select(F.col("__range").alias("__r"), F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    inside = Window.partitionBy("__range").orderBy(*order, "__rank").rowsBetween(Window.unboundedPreceding, 0)
    held = dealt.withColumn("__open", F.last("stack", ignorenulls=True).over(inside)).filter("__rank = 1")
    joined = held.join(F.broadcast(carried), F.col("__range") == F.col("__r"))
    return joined.withColumn("stack", F.coalesce("__open", "__carried")).drop("__open", "__carried", "__r", "__range", "__rank")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages."""
    host, path = split_url(F.col(url))
    known = rules.select(F.lower("verdict").alias("verdict"), F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).filter("host <> ''")
    known = cut(known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")
    rows = pages.select(F.monotonically_increasing_id().alias("row_no"), F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    by_host = swept(rows.withColumn("key", host_key(F.col("host"))), host_starts(known), ["key"])
    active = F.filter("stack", lambda h: F.startswith(F.col("key"), host_key(h)))
    by_host = cut(by_host.withColumn("active", F.coalesce(active, F.array().cast("array<string>"))).select("row_no", "page_id", "host", "path", "active"), "hosts")
    wide = by_host.filter(F.size("active") > 0).select("row_no", "page_id", "host", F.col("path").alias("key"), F.explode("active").alias("rule_host"))
    by_path = swept(wide, path_starts(known), ["rule_host", "key"])
    # a stack of another host than the row's is what the sweep left before the first rule of its host
    fits = F.filter("stack", lambda r: (r["host"] == F.col("rule_host")) & F.startswith(F.col("key"), r["path"]))
    best = by_path.groupBy("row_no", "page_id", "host", F.col("key").alias("path")).agg(F.max(F.array_max(fits)).alias("best"))
    judged = best.select("page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    free = by_host.filter(F.size("active") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(free)
