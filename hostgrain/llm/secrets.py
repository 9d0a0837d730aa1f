"""Secret scans over an incremental blob ledger.

Every historical version of a path is content-addressed (SHA-256 of its text), so that a text that occurs
under many paths or versions is one blob. The ledger holds the pairs of blob and rule version that have been
scanned; only unseen pairs are scanned, and what is found in a blob is joined back to all its paths. So a new version of
one rule costs a scan by that rule, and texts that were there before cost their hash.

Everything is DataFrame operations: a rule's matches come from ``regexp_extract_all``, and their positions from
the lengths of what ``split`` by the same pattern leaves between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_copied


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern (its group 0), of which those stay whose measured group has
    at least min_length characters. only_if: a cheap pattern without which there can be no match."""

    kind: str
    pattern: str
    measured: int = 0
    min_length: int = 1
    version: int = 1
    only_if: str | None = None


# Fixed patterns. Runs of one class are maximal, so that a minimum length within the pattern drops the same ones.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"

RULES = (
    Rule("assign", ASSIGN, measured=2, min_length=12, only_if=r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", ACCESS, min_length=18, only_if="AKIA"),
    Rule("hex", HEX, min_length=16),
)

SPAN = "array<struct<start:int,end:int>>"


def may_match(text: Column, rule: Rule) -> Column:
    return F.regexp_like(text, F.lit(rule.only_if or rule.pattern))


def _lengths(text: Column, rule: Rule) -> Column:
    """Of each match and the text before it: their lengths, and that of the measured group; last the text after them all."""
    p = F.lit(rule.pattern)
    length = lambda x: F.length(x)
    whole = F.transform(F.regexp_extract_all(text, p, 0), length)
    measured = F.transform(F.regexp_extract_all(text, p, rule.measured), length) if rule.measured else whole
    return F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), length).alias("before"), whole.alias("whole"), measured.alias("measured"))


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, kind and ``spans``, by start, of every blob and kind that holds any: start and end in code points, end exclusive.

    blobs: blob, ``_content`` and ``kinds``, the rules to be tried. Positions are running sums over a text's matches,
    a row each, so that the work grows with their number and not its square.
    """
    tries = [F.when(F.array_contains("kinds", r.kind) & may_match(F.col("_content"), r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.min_length).alias("least"), _lengths(F.col("_content"), r).alias("lengths"))) for r in rules]
    tried = blobs.select("blob", F.explode(F.array(*tries)).alias("x")).filter(F.col("x").isNotNull()).select("blob", "x.kind", "x.least", F.posexplode("x.lengths").alias("i", "n"))
    order = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = tried.withColumn("end", F.sum(F.coalesce("n.before", F.lit(0)) + F.coalesce("n.whole", F.lit(0))).over(order).cast("int"))
    held = ends.filter(F.col("n.measured") >= F.col("least")).select("blob", "kind", F.struct((F.col("end") - F.col("n.whole")).alias("start"), "end").alias("span"))
    return held.groupBy("blob", "kind").agg(F.array_sort(F.collect_list("span")).cast(SPAN).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the ledger's new rows.

    versions: path and content, one row per historical version; null contents are empty. Other columns are not
    looked at. ledger: ``blob, kind, version, spans`` of earlier scans. Findings: path, ``blob`` and, per rule, an array
    of (start, end) named after its kind, in the versions' multiplicity: repeated rows stay. New ledger rows
    are to be appended to the ledger once the scan is over; a blob without findings has a row with no spans.

    Every text is read once, where it lies, to be hashed and tried by each rule's cheap pattern; only what passes one is
    moved, and scanned once a blob for the rules in whose version the ledger doesn't hold it.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    own = versions.select(F.col(path).alias("path"), text.alias("_content"))
    passing = F.filter(F.array(*(F.when(may_match(F.col("_content"), r), F.lit(r.kind)) for r in rules)), lambda k: k.isNotNull())
    own = own.select("path", F.sha2("_content", 256).alias("blob"), "_content", passing.alias("passing"))
    own = cut(own.withColumn("_content", F.when(F.size("passing") > 0, F.col("_content"))))

    at_hand = own.select("blob", "passing").distinct()
    force = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    pairs = at_hand.select("blob", "passing", F.explode(force).alias("x")).select("blob", "x.kind", "x.version", F.array_contains("passing", F.col("x.kind")).alias("passes"))
    old = None
    if ledger is not None:
        old = ledger.filter(F.array_contains(force, F.struct("kind", "version"))).join(at_hand.select("blob"), "blob", "left_semi")
        old = cut(old.dropDuplicates(["blob", "kind"]).select("blob", "kind", "spans"))
        pairs = pairs.join(old.select("blob", "kind"), ["blob", "kind"], "left_anti")
    pairs = cut(pairs)
    due = pairs.filter("passes").groupBy("blob").agg(F.collect_set("kind").alias("kinds"))
    texts = own.filter(F.col("_content").isNotNull()).groupBy("blob").agg(F.any_value("_content").alias("_content"))
    found = cut(find_spans(texts.join(due, "blob"), rules))
    none = F.array().cast(SPAN)
    news = pairs.join(found, ["blob", "kind"], "left").select("blob", "kind", "version", F.coalesce("spans", none).alias("spans"))
    # Few blobs hold anything: only those are joined back, the others have empty arrays.
    known = found if old is None else found.unionByName(old.filter(F.size("spans") > 0))
    holding = known.groupBy("blob").agg(*(F.any_value(F.when(F.col("kind") == r.kind, F.col("spans")), True).alias(r.kind) for r in rules))
    out = join_copied(own.select("path", "blob"), holding, "blob", "path", "left")
    return out.select("path", "blob", *(F.coalesce(r.kind, none).alias(r.kind) for r in rules)), news


def scan_into(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, path: str = "path", content: str = "content") -> DataFrame:
    """Findings of every version, as scan() gives them. Pairs of blob and rule version that the ledger at ledger_path
    holds are not scanned again; the others are appended to it. The folder may not be there yet. If a run ends early, the
    next scans again what the ledger lacks."""
    spark = versions.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    ledger = spark.read.schema(f"blob string, spans {SPAN}, kind string, version int").parquet(ledger_path) if there else None
    found, news = scan(versions, ledger, rules, path, content)
    news.write.mode("append").partitionBy("kind", "version").parquet(ledger_path)
    return found


def joined_spans(kinds: list[str]) -> Column:
    """``kind:start:end`` of all kinds, by start and then in the order of kinds, joined by commas."""

    def texts(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text")))

    each = [texts(n, k) for n, k in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*each)), lambda s: s["text"]), ",")


