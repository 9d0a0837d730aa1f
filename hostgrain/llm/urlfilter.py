"""URL filters as a sort-merge range join.

A host is written with its labels reversed (``www.example.com`` becomes ``com.example.www.``), each with an end that
no label holds, so a rule on a host and all its subdomains is the
interval of keys that start with the rule's key. Rule keys and the distinct hosts of the data are
range-partitioned and sorted together; a sweep over the sorted keys keeps a stack of the rule hosts
whose intervals are open: slot d of the stack holds the last rule host of d labels, and it is open
while the key still starts with it. What is open at the start of a partition comes from a prefix scan
over one summary row per partition. The host's stack then decides each url of that host: of the
stacked rules whose path is a prefix of the url's, the longest wins.

All steps are DataFrame operations. Hot hosts are pre-aggregated before the sort; the join back to the
urls is an equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Ends each label of a key. A host may hold it, and what it is escaped with, so these are escaped.
SEP, ESCAPE = "\x01", "\x02"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    plain = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(SEP), F.lit(ESCAPE + "\x03"))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), SEP), F.lit(SEP)))


def match_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", partitions: int | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to the rows of urls.

    rules: ``host``, ``path`` (a prefix, from its ``/``) and ``verdict``. A rule fits its host and all
    subdomains where the url's path starts with the rule's; the longest wins (of equally long ones that
    with the longer host, then the one that blocks). Without a fitting rule, ``rule`` is null and
    ``verdict`` the default. Null urls and those without ``://`` have an empty host and path and fit no
    rule; repeated rows stay; empty tables give empty results or the default. Columns of urls with the
    names of the added ones are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    base = urls.drop(*added).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    by_host = (
        rules.select(ascii_lower("host").alias("host"), "path", "verdict").dropna().filter("host <> ''")
        .groupBy("host")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("path"), F.col("verdict")))).alias("rules"))
        .withColumn("_key", host_key(F.col("host")))
        .withColumn("depth", F.size(F.split("host", r"\.")))
    )
    depth = by_host.agg(F.max("depth")).first()[0] or 0
    if not depth:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    n = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = (
        base.select("host").filter("host <> ''").distinct().withColumn("_key", host_key(F.col("host"))).withColumn("entry", F.lit(None).cast(_entry(by_host)))
        .unionByName(by_host.select(F.lit(None).cast("string").alias("host"), "_key", F.struct("_key", "host", "depth", "rules").alias("entry")))
    )
    # Range bounds are drawn by sampling, so the partition number is kept with the rows before two readers need it.
    sorted_points = cut(points.repartitionByRange(n, "_key").withColumn("pid", F.spark_partition_id()))

    slots = range(1, depth + 1)
    slot = {d: F.when(F.col("entry.depth") == d, F.col("entry")) for d in slots}
    ends = sorted_points.filter(F.col("entry").isNotNull()).groupBy("pid").agg(*(F.max(slot[d]).alias(f"end{d}") for d in slots))
    every = sorted_points.select("pid").distinct().join(ends, "pid", "left")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("pid", *(F.last(f"end{d}", ignorenulls=True).over(before).alias(f"carry{d}") for d in slots))

    # Rules come before the hosts with the same key, so that they are on the stack when the host is met.
    sweep = Window.partitionBy("pid").orderBy("_key", F.col("entry").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = sorted_points.select("pid", "host", "_key", "entry", *(F.last(slot[d], ignorenulls=True).over(sweep).alias(f"slot{d}") for d in slots))
    swept = swept.filter(F.col("entry").isNull()).join(carried, "pid", "left")
    held = [F.coalesce(f"slot{d}", f"carry{d}") for d in slots]
    stack = F.filter(F.array(*held), lambda e: e.isNotNull() & F.startswith(F.col("_key"), e["_key"]))
    stacked = swept.select("host", stack.alias("_stack")).filter(F.size("_stack") > 0)

    fitting = F.flatten(
        F.transform(
            "_stack",
            lambda e: F.transform(
                F.filter(e["rules"], lambda r: F.startswith(F.col("path"), r["path"])),
                lambda r: F.struct(
                    (F.length(e["host"]) + F.length(r["path"])).alias("n"),
                    F.length(e["host"]).alias("n_host"),
                    (r["verdict"] == "block").cast("int").alias("blocks"),
                    F.concat(e["host"], r["path"]).alias("rule"),
                    r["verdict"].alias("verdict"),
                ),
            ),
        )
    )
    out = base.join(stacked, "host", "left").withColumn("_best", F.array_max(fitting))
    rest = [c for c in base.columns if c not in added]
    return out.select(*rest, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def _entry(by_host: DataFrame) -> str:
    types = dict(by_host.dtypes)
    return f"struct<_key:string,host:string,depth:int,rules:{types['rules']}>"


def rules_frame(spark, rules) -> DataFrame:
    """(host, path, verdict) triples as a DataFrame."""
    rows = [f"({', '.join(repr(str(x)) for x in r)})" for r in rules]
    if not rows:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(host, path, verdict)")


