"""Line deduplication by a log-template tree.

A line is its tokens; a token that holds a digit is a variable field and written ``<*>``. The tree has a fixed depth: the
first level is the token count, the next ``depth`` levels are the leading tokens. In each leaf a position's token stays
literal only if it is frequent there, otherwise it is a field too; what is left is the line's template. A template that
recurs across documents is dropped from all but one of them.

Frequent is meant in proportion: a line has to have a certain number of constants (``needed``), and its level is the
largest frequency that so many of its tokens reach. Tokens with less than half of that are fields. So a name that some
lines share is still a field of a template that many more share, and a line that recurs as it stands has no fields.

Everything is DataFrame operations, without Python in any task, and in proportion to the lines. A line of n tokens may
have one field for each FIELD_EVERY of them, f, besides tokens with digits. What is counted first are hashes of its
f + 1 equal parts: two lines of one template differ at f places at most, and so agree in a whole part. Lines that share a part
with a different line go on to be counted token by token, once for each distinct line, however often it occurs; any
other line is its own template. (Whether lines differ is told by 64 bits in that first count, which is most of what is shuffled.)
Documents of equal text count once, so that copies of a document don't make templates of all its lines.

Templates, lines and rows are told apart by two 64-bit hashes, 128 bits. Texts are told apart by 64 bits: that only matters
between the texts of one template.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear_cuts, cut, cuts_written, heavy_limit, join_to_one

WILD = "<*>"
BLANK = " \t\x0b\x0c\r"
#: A line may have a field without a digit for each FIELD_EVERY tokens.
FIELD_EVERY = 5
COUNT_BITS = 40
#: Heavy parts are found in one row of so many.
DRAWN = 64


def tokens_of(line: Column) -> Column:
    """Tokens of a trimmed line; each with a digit in it is a variable field."""
    masked = F.regexp_replace(line, r"(?<!\S)[^\s\d]*+\d\S*+", WILD)  # \s and \d are ASCII's
    masked = F.when(F.regexp_like(line, F.lit("[0-9]")), masked).otherwise(line)
    # Split at single spaces, which takes no regular expression. Few lines have other blanks, or several at once.
    spaced = F.array_remove(F.split(F.translate(masked, "\t\n\x0b\x0c\r", "     "), " ", -1), "")
    odd = reduce(Column.__or__, (F.contains(line, F.lit(b)) for b in ("\t", "\n", "\x0b", "\x0c", "\r", "  ")), line == "")
    return F.when(odd, spaced).otherwise(F.split(masked, " ", -1))


def stripped(line: Column) -> Column:
    """The line without blanks around it. Trimming walks all of a line, so only lines that need it go there."""
    odd = reduce(Column.__or__, (end(line, F.lit(b)) for b in BLANK for end in (F.startswith, F.endswith)))
    return F.when(odd, F.btrim(line, F.lit(BLANK))).otherwise(line)


def needed(n: Column, wild: Column) -> Column:
    """How many of n tokens, wild of them with a digit, a template has to keep as constants: half at least."""
    return F.greatest(F.ceil(n / 2), n - wild - free(n)).cast("int")


def free(n: Column) -> Column:
    return F.floor(n / FIELD_EVERY).cast("int")


def _hashes(value: Column, *names: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), value).alias(name) for i, name in enumerate(names)]


def _lines(rows: DataFrame, depth: int, min_bytes: int) -> DataFrame:
    """Of each line that counts: the hashes of its parts within their leaf, null if it has no fields, and two of all."""
    lines = rows.filter(F.col("text").isNotNull()).select("doc_id", "_x", "_r", F.posexplode(F.split("text", "\n", -1)).alias("line", "_s"))
    # Through generators, so that the filters on what they give aren't pushed below and trim or split the line again.
    lines = lines.select("doc_id", "_x", "_r", "line", F.explode(F.array(stripped(F.col("_s")))).alias("_s")).filter(F.octet_length("_s") >= min_bytes)
    lines = lines.select("doc_id", "_x", "_r", "line", F.explode(F.array(tokens_of(F.col("_s")))).alias("_t"))
    n, t = F.size("_t"), F.col("_t")
    lines = lines.filter(~F.array_contains(t, WILD) | (2 * F.size(F.array_remove(t, WILD)) >= n))

    # What all parts of a line need is computed once, through a generator again.
    own = F.struct(free(n).alias("f"), n.alias("n"), F.xxhash64(n, F.slice(t, 1, depth)).alias("leaf"))
    lines = lines.select("doc_id", "_x", "_r", "line", "_t", F.explode(F.array(own)).alias("_o"))
    size, fields, leaf = F.col("_o.n"), F.col("_o.f"), F.col("_o.leaf")

    def part(i: Column) -> Column:
        first, after = (F.floor(size * k / (fields + 1)).cast("int") for k in (i, i + 1))
        return F.xxhash64(leaf, i, F.slice(t, first + 1, after - first))

    parts = F.when(fields > 0, F.transform(F.sequence(F.lit(0), fields), part)).otherwise(F.array(*(F.xxhash64(F.lit(i), t) for i in (-1, -2))))
    lines = lines.select("doc_id", "_x", "_r", "line", fields.alias("_f"), F.explode(F.array(parts)).alias("_parts"))
    return lines.select("doc_id", "_x", "_r", "line", F.when(F.col("_f") > 0, F.col("_parts")).alias("_parts"), *_hashes(F.col("_parts"), "_e1", "_e2"))


def _varying(lines: DataFrame) -> DataFrame:
    """_e1 of the lines that share a part with a different line, each once.

    Parts are shuffled once, and lines of a part compared where they then lie. Parts that many rows hold don't meet there: whether
    their lines differ is told by partial results of all tasks first, and broadcast, and their rows are dealt out by themselves. Every
    row of a part passes a join once, whatever its part holds: filters come after what gathers rows, since the optimizer would
    make inner joins of these. Which parts these are, one row in DRAWN tells; that decides only how a part is treated, not what comes out."""
    row = F.xxhash64("_r", "line")
    drawn = lines.filter(F.pmod(row, F.lit(DRAWN)) == 0).select(F.explode("_parts").alias("_part"))
    heavy = cut(drawn.groupBy("_part").agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy_limit(drawn.count())).select("_part", F.lit(True).alias("_heavy")))
    if not heavy.take(1):
        return _differing(lines.select("_e1", F.explode("_parts").alias("_part")), F.lit(None)).distinct()
    parts = lines.select("_e1", row.alias("_row"), F.explode("_parts").alias("_part"))
    ends = parts.join(F.broadcast(heavy), "_part", "left").groupBy(F.when(F.col("_heavy"), F.col("_part")).alias("_part"))
    # The light ones' row has a null part, which fits none.
    told = cut(ends.agg((F.min("_e1") < F.max("_e1")).alias("_shared")))
    told = parts.join(F.broadcast(told), "_part", "left")
    apart = F.when(F.col("_shared").isNull(), F.col("_part")).otherwise(F.xxhash64("_part", "_row"))
    return _differing(told.select("_e1", apart.alias("_part"), "_shared"), F.col("_shared")).distinct()


def _differing(parts: DataFrame, told: Column) -> DataFrame:
    """_e1 of the rows of which told says so, or where it is null, whose part a row of another _e1 holds as well."""
    of_part = Window.partitionBy("_part")
    found = parts.withColumns({"_a": F.min("_e1").over(of_part), "_b": F.max("_e1").over(of_part)})
    return found.filter(F.coalesce(told.cast("boolean"), F.col("_a") != F.col("_b"))).select("_e1")


def _templates(candidates: DataFrame, rows: DataFrame, depth: int) -> DataFrame:
    """_e1, _e2 of the distinct lines that have a template with enough constants, and the template's hashes _k1, _k2."""
    per_text = candidates.groupBy("_e1", "_e2", "_x").agg(F.min(F.struct("_r", "line")).alias("_at"))
    distinct = per_text.groupBy("_e1", "_e2").agg(F.count("*").alias("_texts"), F.min("_at").alias("_at"))
    distinct = cut(distinct.select("_e1", "_e2", "_texts", "_at._r", "_at.line"))
    # Merged at every size: these may be a good part of all rows.
    of_rows = rows.join(distinct.select("_r").distinct().hint("merge"), "_r", "left_semi").select("_r", F.posexplode(F.split("text", "\n", -1)).alias("line", "_s"))
    found = of_rows.join(distinct, ["_r", "line"]).dropDuplicates(["_e1", "_e2"]).withColumn("_s", F.explode(F.array(stripped(F.col("_s")))))
    found = cut(found.select("_e1", "_e2", "_texts", tokens_of(F.col("_s")).alias("_t")))

    # A token's place and, in the lowest COUNT_BITS, how often its leaf has it there, in one number.
    leaf = F.xxhash64(F.size("_t"), F.slice("_t", 1, depth)).alias("_leaf")
    tokens = found.select("_e1", "_e2", "_texts", leaf, F.posexplode("_t").alias("_p", "_token"))
    tokens = tokens.filter(F.col("_token") != WILD).select("_e1", "_e2", "_texts", "_p", F.xxhash64("_leaf", "_p", "_token").alias("_key"))
    frequent = tokens.groupBy("_key").agg(F.sum("_texts").alias("_seen")).filter("_seen > 1")
    marked = tokens.drop("_texts").join(frequent, "_key").select("_e1", "_e2", F.shiftleft(F.col("_p").cast("long"), COUNT_BITS).bitwiseOR(F.col("_seen")).alias("_mark"))
    marked = marked.groupBy("_e1", "_e2").agg(F.collect_list("_mark").alias("_marks"))
    count = lambda m: m.bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    counts = F.sort_array(F.transform("_marks", count), False)
    joined = marked.join(found.drop("_texts"), ["_e1", "_e2"])
    n = F.size("_t")
    level = F.get(counts, needed(n, n - F.size(F.array_remove("_t", WILD))) - 1)
    # Through a generator, so that the level isn't computed for each mark.
    leveled = joined.select("_e1", "_e2", "_t", "_marks", F.explode(F.array(level)).alias("_level")).filter(F.col("_level").isNotNull())
    constant = F.sort_array(F.transform(F.filter("_marks", lambda m: 2 * count(m) >= F.col("_level")), lambda m: F.shiftright(m, COUNT_BITS).cast("int")))
    # Constants with their places are the template; all other places are fields.
    whole = leveled.select("_e1", "_e2", F.size("_t").alias("_n"), "_t", F.explode(F.array(constant)).alias("_places"))
    template = F.transform("_places", lambda i: F.get(F.col("_t"), i))
    return whole.select("_e1", "_e2", *(F.xxhash64(F.lit(i), "_n", "_places", template).alias(f"_k{i}") for i in (1, 2)))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, depth: int = 1, min_bytes: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``text`` without the dropped lines, ``n_lines`` and ``dropped`` (their numbers, from 0) of every row.

    A template that occurs in at least min_docs (two or more) different texts is dropped from every text but the one with
    the least doc_id (null before all others; of one id, the least hash), where it stays as often as it stands. Lines
    end at ``\\n`` only. Lines of less than min_bytes (UTF-8, without blanks around them), and lines of which more than half
    of the tokens have a digit, have no template and always stay; so do lines of white space. Null texts stay null with no lines, empty texts have one
    line. Texts of equal content lose the same lines unless one holds what stays; repeated rows are kept. An empty
    table gives an empty result. Other columns are not looked at.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).withColumns({"_x": F.xxhash64("text"), "_r": F.struct(*_hashes(F.struct("doc_id", "text"), "a", "b"))})
    written = cuts_written()
    lines = cut(_lines(rows, depth, min_bytes))  # texts are split into tokens once
    varying = cut(_varying(lines))
    per_line = lines.groupBy("_e1", "_e2").agg(F.count("*").alias("_n"), (F.min("_x") < F.max("_x")).alias("_twice"))
    per_line = per_line.join(varying.withColumn("_varies", F.lit(True)), "_e1", "left").filter("_varies OR _twice")
    per_line = cut(per_line.select("_e1", "_e2", "_n", F.coalesce("_varies", F.lit(False)).alias("_varies")))
    candidates = cut(join_to_one(lines.drop("_parts"), per_line, ["_e1", "_e2"], lines.count()))
    clear_cuts(docs.sparkSession, written, keep_last=True)  # nothing later reads the parts of all lines

    varying, same = candidates.filter("_varies"), candidates.filter("NOT _varies")
    found = varying.join(_templates(varying, rows, depth), ["_e1", "_e2"]).drop("_e1", "_e2")
    found = cut(found.unionByName(same.withColumnsRenamed({"_e1": "_k1", "_e2": "_k2"})))
    per_text = found.groupBy("_k1", "_k2", "_x").agg(F.min("doc_id").alias("_first"))
    per_template = cut(per_text.groupBy("_k1", "_k2").agg(F.count("*").alias("_n"), F.min(F.struct("_first", "_x")).alias("_keeps")).filter(F.col("_n") >= min_docs))
    stays = F.col("doc_id").eqNullSafe(F.col("_keeps._first")) & (F.col("_x") == F.col("_keeps._x"))
    hits = join_to_one(found, per_template, ["_k1", "_k2"], found.count()).filter(~stays).groupBy("_r").agg(F.sort_array(F.collect_set("line")).alias("dropped"))

    out = rows.join(hits, "_r", "left").withColumn("_lines", F.split("text", "\n", -1))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "dropped")
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    return out.select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("text"), n_lines.alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )
