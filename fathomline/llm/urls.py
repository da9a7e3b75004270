"""URL filters as a sort-merge range join, in DataFrame operations only.

A host's labels are reversed (``www.example.com`` becomes ``com.example.www.``), so a rule for a host and its
subdomains is the interval of keys that begin with the rule's key. Intervals of rules are nested or apart. Every end of
an interval is an event that carries the stack of the rules that are active from there on. URLs and events are sorted
by key; the sweep hands each URL the stack of the last event before it. Of that stack the rules whose path begins the
URL's path fit, and the longest decides.

Scale: the sweep runs in parts: by top-level label and, since one label may hold most URLs, by a hash of the URL. The
events of a label are repeated for each of those parts. Windows stream over sorted rows, so no part is held in memory.

Cases: a null URL, or one without ``://``, has an empty host and path and no rule; such and all URLs that no rule fits
get the default verdict. Repeated rules count once; of rules alike in host and path the blocking one holds. Ties in
length go to the longer host. Rules need a host. Very long urls are looked at whole; repeated rows are judged each, also
rows without a page_id; an empty table gives an empty result, and without rules the default verdict alone holds; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEFAULT = "allow"
#: Above every key that begins with the same labels.
TOP = "\U0010ffff"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url):
    """Host, A-Z lower-cased, and path of a URL column, as contracts define them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, path


def key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit("."))


def events(rules: DataFrame) -> DataFrame:
    """Keys at which the stack of active rules changes, with that stack."""
    r = rules.filter(F.length("host") > 0).groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    r = r.withColumn("key", key(F.col("host")))
    hosts = r.select("key").distinct()
    labels = F.split(F.col("key"), "\\.", -1)
    n = F.size(labels) - 1
    prefix = lambda k: F.concat(F.array_join(F.slice(labels, 1, k), "."), F.lit("."))
    opens = hosts.select("key", F.lit(0).alias("kind"), F.transform(F.sequence(F.lit(1), n), prefix).alias("active"))
    closes = hosts.select(F.concat("key", F.lit(TOP)).alias("key"), F.lit(2).alias("kind"), F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), prefix)).otherwise(F.array().cast("array<string>")).alias("active"))
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.col("path").alias("path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))
    by_key = r.groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    both = opens.unionByName(closes).withColumn("a", F.explode_outer("active"))
    return both.join(by_key, both.a == by_key.k, "left").groupBy("key", "kind").agg(F.flatten(F.collect_list("rules")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT, parts: int = 16) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    rules = rules_table(pages.sparkSession) if rules is None else rules
    host, path = host_and_path(F.col("url"))
    top = F.substring_index(F.col("key"), ".", 1)
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(parts)).cast("int").alias("part"))
    urls = urls.withColumn("key", key(F.col("host"))).withColumn("kind", F.lit(1)).withColumn("top", top)
    marks = events(rules).withColumn("top", top).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = urls.unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("top", "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter(F.col("kind") == 1)
    best = F.array_max(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])))
    found = swept.withColumn("best", F.when(F.length("host") > 0, best))
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
