"""Vector codes against plain Python, on awkward vectors and on the small tables."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hostgrain.llm import common, queries, vectorcodes
from hostgrain.llm.vectorcodes import compress_vectors, with_group_error
from hostgrain.llm.vectorcodes import digest as books_digest

SF = "/root/testdata/sf0.001"
COLUMNS = "vec_id long, embedding array<double>, label int, code string, _v string"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, label, code, error) of the kept rows, sorted, and the codebooks."""
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                members[p][nearest(v, p)[0]].append(cut(v, p))
        books = [[[sum(x) // len(m) for x in zip(*m)] if (m := members[p].get(e)) else old for e, old in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, v, lab in kept:
        got = [nearest(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got)))
    return out, books


def key(r):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)


def vectors(n, dims, spread=1.0):
    return [(i, [math.sin(1 + i * 7.3 + d * d) * (1 + (i % 5) * spread) for d in range(dims)], None if i % 7 == 0 else i % 3) for i in range(n)]


AWKWARD = [
    (100, None, 1), (101, [0.5] * 15 + [None], 1), (102, [float("nan")] + [0.1] * 15, 1), (103, [float("inf")] + [0.1] * 15, None), (104, [-float("inf")] * 16, 2),
    (105, [-0.0] * 16, 1), (106, [0.0] * 16, 1), (106, [0.0] * 16, 1), (None, [0.25] * 16, None), (107, [-1e-9] * 16, 2), (108, [], 1), (109, [0.3] * 16, 2),
]


@pytest.mark.parametrize("rows", [vectors(60, 16) + AWKWARD, vectors(5, 16), [*vectors(40, 8, 3.0), *vectors(40, 8, 3.0)]])
def test_against_plain_python(spark, rows):
    df = spark.createDataFrame([(*r, "c", "v") for r in rows], COLUMNS).repartition(5)
    coded, books = compress_vectors(df, keep=("label",))
    want, want_books = plain(rows)
    assert books == want_books
    assert sorted(map(tuple, coded.select("vec_id", "label", "code", "error").collect()), key=key) == sorted(want, key=key)
    assert books_digest(books) == hashlib.sha256(",".join(str(x) for p in want_books for e in p for x in e).encode()).hexdigest()


def test_numbers_that_64_bits_cannot_hold(spark):
    rows = vectors(30, 16) + [(200 + i, [(-1) ** i * 1e30 * (i + 1)] * 8 + [1e5 * i] * 8, 1) for i in range(6)]
    coded, books = compress_vectors(spark.createDataFrame([(*r, "c", "v") for r in rows], COLUMNS).repartition(4), keep=("label",))
    want, want_books = plain(rows)
    assert books == want_books
    want = [(*r[:3], r[3] if r[3] < 2**63 else None) for r in want]
    assert sorted(map(tuple, coded.select("vec_id", "label", "code", "error").collect()), key=key) == sorted(want, key=key)


def test_length_of_the_first_vector_holds(spark):
    rows = [(1, [0.1] * 7, 1), (2, [0.1] * 16, 1), (3, [0.1] * 8, 1), (4, [0.2] * 16, 2), (5, [0.2] * 24, 2)]
    coded, _ = compress_vectors(spark.createDataFrame([(*r, "c", "v") for r in rows], COLUMNS))
    assert sorted(r.vec_id for r in coded.collect()) == [2, 4]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1, "c", "v")]):
        coded, books = compress_vectors(spark.createDataFrame(rows, COLUMNS), keep=("label",))
        assert coded.columns == ["vec_id", "label", "code", "error"] and coded.count() == 0 and books == [] and with_group_error(coded, "label").count() == 0


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = vectors(300, 16)
    df = spark.createDataFrame([(*r, "c", "v") for r in rows], COLUMNS)
    want = plain(rows)[1]
    for block, parts in ((1, 1), (7, 3), (4096, 16)):
        monkeypatch.setattr(vectorcodes, "BLOCK", block)
        assert compress_vectors(df.repartition(parts))[1] == want


def test_errors_of_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 2)
    monkeypatch.setattr(common, "HEAVY_SHARE", 3)
    df = spark.createDataFrame([(i, None if i % 2 else i % 5, i) for i in range(100)], "vec_id long, label int, error long")
    sums = defaultdict(int)
    for i in range(100):
        sums[None if i % 2 else i % 5] += i
    got = with_group_error(df, "label").collect()
    assert len(got) == 100 and all(r.label_error == sums[r.label] for r in got)
    big = with_group_error(df.withColumn("error", F.lit(2**62)), "label")
    assert {r.label_error for r in big.collect()} == {None}


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, books = plain(rows)
    sums = defaultdict(int)
    for _, lab, _, e in want:
        sums[lab] += e
    got = queries.op13_vector_codes(spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted((i, c, e, sums[lab], books_digest(books)) for i, lab, c, e in want)
