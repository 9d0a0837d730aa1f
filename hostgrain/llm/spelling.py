"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by walks down a trie.

The trie is a table of nodes. A node is a prefix that two or more words share, with its next letters, the number of words
below each, and, where that is one word, the word itself; so no chain that leads to a single word takes nodes.

A state is (word, target, position, node): the word with one edit at the place where both first differ, and how far down
the trie the target has been found. In each round all states go down one level by a join with the nodes. A state whose
target turns out to be a word makes the two neighbours; one whose next letter isn't there ends.

Near the root every node has many children, so walks that begin there would be many and futile. Hence two tries, of words
and of reversed words: the first finds edits in the second half of a word, the other those in the first half. An edit to
another letter is tried only from the child with fewer words to that with more, which finds each pair once.

Everything is DataFrame operations. A node that a third of all words share is one row with at most as many children as
there are letters; words are joined with it where they lie (``join_to_one``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, join_to_one

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
#: Marks of the two tries, in front of their prefixes.
FORWARD, BACKWARD = ">", "<"


def damaged_words(docs: DataFrame, min_length: int = 7, every: int = 31, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` of each run of letters, A-Z lower-cased. Of one run in every, by crc32 of ``<id>:<run>``, one letter is
    deleted. Only words of min_length code points or more; without an id nothing is deleted."""
    runs = docs.select(F.col(id).cast("string").alias("_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.filter(F.length("_run") >= min_length).select("_id", ascii_lower("_run").alias("_run"))
    h, n = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")), F.length("_run")
    at = (h % n).cast("int")
    less = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, n))
    return runs.select(F.when(h % every == 0, less).otherwise(F.col("_run")).alias("word")).filter(F.length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = 2) -> DataFrame:
    """Distinct words and how often they occur, n, if that is at least min_count."""
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _turned(vocab: DataFrame) -> DataFrame:
    """Each word twice: ``_x`` as it stands and reversed, with the mark of its trie and the first position it is edited at."""
    n = F.length("word")
    two = F.array(
        F.struct(F.lit(FORWARD).alias("side"), F.col("word").alias("x"), _half(n).alias("from")),
        F.struct(F.lit(BACKWARD).alias("side"), F.reverse("word").alias("x"), (n - _half(n)).alias("from")),
    )
    return vocab.select(F.col("n").alias("_f"), F.explode(two).alias("_t")).select("_f", F.col("_t.side").alias("_side"), F.col("_t.x").alias("_x"), F.col("_t.from").alias("_from"))


def _letter(text: str, at: Column) -> Column:
    """The code point at a position from 0; an empty text after the end."""
    return F.substring(text, at + 1, 1)


def _prefix(text: str, n: Column) -> Column:
    return F.concat("_side", F.substring(text, F.lit(1), n))


def trie_nodes(turned: DataFrame, min_depth: int) -> DataFrame:
    """Nodes of min_depth letters or more that at least two words share: ``_node`` (mark and prefix), ``_n`` (their
    number) and ``_children``: letter (empty where the prefix is a word), words below, and if that is one, the word and how often it occurs."""
    k = F.col("_k")
    steps = turned.select("_side", "_x", "_f", F.explode(F.sequence(F.lit(min_depth), F.length("_x"))).alias("_k"))
    edges = steps.select(_prefix("_x", k).alias("_node"), _letter("_x", k).alias("c"), "_x", "_f").groupBy("_node", "c")
    edges = edges.agg(F.count("*").alias("n"), F.min(F.struct("_x", "_f")).alias("_only"))
    only = F.col("n") == 1
    edges = edges.select("_node", "n", F.struct("c", "n", F.when(only, F.col("_only._x")).alias("w"), F.when(only, F.col("_only._f")).alias("f")).alias("_child"))
    nodes = edges.groupBy("_node").agg(F.sum("n").alias("_n"), F.collect_list("_child").alias("_children"))  # at most as many as letters
    return nodes.filter("_n > 1")


def _first_states(turned: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """A state for each edit that a word can have below the nodes it passes: ``_t`` is the target and ``_d`` how many
    of its letters are found, ``_w`` and ``_g`` the only word that begins so, if there is one, and its number."""
    k, x, children = F.col("_k"), F.col("_x"), F.col("_children")
    last = F.length("_x") - 1
    rows = turned.select("*", F.explode(F.when(F.col("_from") <= last, F.sequence("_from", last))).alias("_k")).withColumn("_node", _prefix("_x", k))
    at = join_to_one(rows, nodes, "_node", total)
    own, after = _letter("_x", k), _letter("_x", k + 1)
    head, tail = F.substring(x, F.lit(1), k), F.substring(x, k + 2, F.length(x))
    mine = F.get(F.filter(children, lambda e: e["c"] == F.col("_own")), F.lit(0))
    state = lambda e, target: F.struct(target.alias("t"), e["w"].alias("w"), e["f"].alias("g"))
    alive = lambda s: s["w"].isNull() | (s["w"] == s["t"])
    at = at.withColumns({"_own": own, "_after": after, "_head": head, "_tail": tail}).withColumn("_mine", mine)
    larger = lambda e: (e["c"] != "") & (e["c"] != F.col("_own")) & (F.struct(e["n"], e["c"]) > F.struct(F.col("_mine")["n"], F.col("_own")))
    replaced = F.transform(F.filter(children, larger), lambda e: state(e, F.concat(F.col("_head"), e["c"], F.col("_tail"))))
    # Deleting any of equal neighbours gives one word: only the last of them is tried.
    shorter = F.transform(F.filter(children, lambda e: (e["c"] == F.col("_after")) & (F.col("_after") != F.col("_own"))), lambda e: state(e, F.concat(F.col("_head"), F.col("_tail"))))
    states = at.select("_side", "_x", "_f", "_from", (k + 1).alias("_d"), F.explode(F.filter(F.concat(replaced, shorter), alive)).alias("_s"))
    states = states.select("_side", "_x", "_f", "_d", F.col("_s.t").alias("_t"), F.col("_s.w").alias("_w"), F.col("_s.g").alias("_g"), "_from")
    # What the other trie finds as well is left to it: words that first differ in their first half.
    half = _half(F.length("_x"))
    ends = lambda c: F.substring(c, F.length(c) - half + 1, half)  # noqa: E731  the first half, reversed
    return states.filter((F.col("_side") == FORWARD) | (ends(F.col("_x")) != ends(F.col("_t")))).drop("_from")


def _down(states: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """The states one level further down: those whose target's next letter follows."""
    rows = states.drop("_w", "_g").withColumns({"_node": _prefix("_t", F.col("_d")), "_c": _letter("_t", F.col("_d"))})
    child = F.filter("_children", lambda e: (e["c"] == F.col("_c")) & (e["w"].isNull() | (e["w"] == F.col("_t"))))
    at = join_to_one(rows, nodes, "_node", total).select("_side", "_x", "_f", (F.col("_d") + 1).alias("_d"), "_t", F.explode(child).alias("_s"))
    return at.select("*", F.col("_s.w").alias("_w"), F.col("_s.f").alias("_g")).drop("_s")


def neighbours(vocab: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of words with one edit between them, both ways. vocab: distinct words and n."""
    turned = _turned(vocab)
    sizes = vocab.agg(F.min(_half(F.length("word"))).alias("least"), F.sum(F.length("word")).alias("letters")).head()
    # Of words at nodes, which are as many as letters, the share of a node decides how it is joined; a node's states are
    # at most its words times the letters there are.
    least, total = sizes.least or 0, sizes.letters or 0
    nodes = cut(trie_nodes(turned, least))
    states, found = cut(_first_states(turned, nodes, total)), None
    while True:
        hit = states.filter(F.col("_w").isNotNull()).select("_side", "_x", "_f", "_t", "_g")
        found = hit if found is None else found.unionByName(hit)
        states = states.filter(F.col("_w").isNull())
        if not states.take(1):
            break
        states = cut(_down(states, nodes, total))
    plain = lambda c: F.when(F.col("_side") == BACKWARD, F.reverse(c)).otherwise(F.col(c))
    pairs = found.select(plain("_x").alias("a"), F.col("_f").alias("an"), plain("_t").alias("b"), F.col("_g").alias("bn"))
    both = F.explode(F.array(*(F.struct(F.col(w).alias("word"), F.col(f"{w}n").alias("n"), F.col(v).alias("near"), F.col(f"{v}n").alias("near_n")) for w, v in ("ab", "ba"))))
    return pairs.select(both.alias("_p")).select("_p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: from each word that has a form, forms followed to the last. Each round doubles the steps taken; counts
    grow by form_factor at each step, so there are as many steps as the largest count has digits, and few rounds."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        hubs = links.groupBy("root").agg(F.count("*").alias("_n"))
        ahead = hubs.join(links.select(F.col("word").alias("root"), F.col("root").alias("_next")), "root")
        if not ahead.take(1):
            return links
        hubs = cut(hubs.join(ahead.select("root", "_next"), "root", "left"))
        links = cut(join_to_one(links, hubs, "root", links.count()).select("word", F.coalesce("_next", "root").alias("root")))


def group_variants(vocab: DataFrame, form_factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (``vocabulary()``; word and n, words distinct).

    n_near counts its neighbours, 0 if there are none. Its form is the neighbour of the largest n, of equal n the first in
    code-point order, if that n is at least form_factor times its own; else null, with a null form_n. root follows
    forms to the last; a word without one is its own root. Null words are dropped; an empty vocabulary gives an empty result."""
    vocab = cut(vocab.filter(F.col("word").isNotNull()).select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = cut(neighbours(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best")))
    named = vocab.join(near, "word", "left").withColumn("form_n", -F.col("_best.less"))
    has = F.col("form_n") >= form_factor * F.col("n")
    named = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("_best.near")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    roots = _roots(named.filter(F.col("form").isNotNull()))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
