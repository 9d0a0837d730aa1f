"""Each stage of the pipeline against brute force on what the one before kept, and on awkward and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline as P
from hostgrain.llm.common import cut
from hostgrain.llm.langid import has_letter
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in P.STAGES:
        out.append(cut(f(spark, out[-1], SF)))
    return [d.collect() for d in out], [d.columns for d in out]


def test_stages(steps):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicate", "decontamination", "mixing", "sharding"]
    _, columns = steps
    assert all(c == columns[0] for c in columns[:-1]) and columns[-1] == ["doc_id", "size", "text_crc32", "shard", "slot"]


def test_language_keeps_texts_with_letters(steps):
    before, after = steps[0][:2]
    kept = {r.doc_id for r in after}
    assert kept <= {r.doc_id for r in before if has_letter(r.text)} and len(kept) >= 0.98 * len(before)
    assert sorted(map(repr, after)) == sorted(repr(r) for r in before if r.doc_id in kept)


def test_one_document_of_each_group_stays(steps):
    before, after = steps[0][1:3]
    want = brute.near_duplicates([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c for _, c in want.values()}) and len(after) < len(before)


def test_contaminated_documents_go(spark, steps):
    before, after = steps[0][2:4]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not brute.hits(r.text, items)[1])


def test_mix_and_shards(steps):
    before, mixed, placed = steps[0][3:6]
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies.values()) <= {1, 2} and set(copies) <= {r.doc_id for r in before}
    words = {r.doc_id: len(brute.re.findall(brute.SPACES, r.text or "")) for r in before}
    total = sum(words.values())
    assert 1.3 * total < sum(words[d] * n for d, n in copies.items()) <= 1.5 * total
    assert Counter(r.doc_id for r in placed) == copies
    shards = {}
    for r in placed:
        assert shards.setdefault(r.doc_id, r.shard) == r.shard
    assert {r.shard for r in placed} == set(range(8))


def test_run_gives_the_same(spark, steps):
    assert sorted(map(repr, P.run(spark, SF).collect())) == sorted(map(repr, steps[0][-1]))


def test_awkward_and_empty_tables(spark):
    rows = [(1, None, None, None, 0, "x"), (2, "", "en", "a", 0, "x"), (3, "hello there my friend, one two three", "en", None, 1, "x"), (3, "hello there my friend, one two three", "en", None, 1, "x"), (4, "1 2 3", "en", "a", 1, "x"), (None, "no id at all here", "de", "b", 1, "x"), (5, "w " * 50_000 + "end", "fr", "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for d in (docs, docs.limit(0)):
        for name, f in P.STAGES:
            d = cut(f(spark, d, SF))
            if name != "sharding":
                assert d.columns == docs.columns
        assert d.filter("doc_id in (1, 2, 4)").count() == 0


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    """Two thirds of these share a null id or the id 1; only what is linked, or contaminated itself, goes."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 12").first().text
    own = lambda n: " ".join(f"w{n}x{i}" for i in range(30))
    rows = [(None, own(i), "a") for i in range(4)] + [(1, own(i), "a") for i in range(4, 8)] + [(1, item, "a"), (2, own(0), "b"), (3, own(5), "b"), (None, None, "a"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in P.near_duplicate(spark, docs, SF).collect())
    want = Counter((d, t) for d, t, _ in rows) - Counter([(None, own(0)), (3, own(5))])
    assert got == want
    assert Counter((r.doc_id, r.text) for r in P.decontamination(spark, docs, SF).collect()) == Counter((d, t) for d, t, _ in rows) - Counter([(1, item)])
    thrice = docs.filter("text is not null").unionByName(docs.filter("doc_id = 2")).unionByName(docs.filter("doc_id = 2"))
    mixed = P.mixing(spark, thrice, SF).collect()
    copies = Counter((r.doc_id, r.text) for r in mixed)
    there = Counter((r.doc_id, r.text) for r in thrice.collect())
    assert all(n <= 2 * there[x] for x, n in copies.items())
    total = sum(len(t.split()) * n for (_, t), n in there.items())
    assert 1.2 * total < sum(len(r.text.split()) for r in mixed) <= 1.5 * total
