"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from hostgrain.llm import common, queries
from hostgrain.llm.spelling import damaged_words, group_variants, neighbours, vocabulary
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def count_words(docs, least=7):
    out = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = brute.lower(run)
            h = zlib.crc32(f"{i}:{low}".encode()) if i is not None else 1
            at = h % len(low)
            word = low[:at] + low[at + 1 :] if h % 31 == 0 else low
            if len(word) >= least:
                out[word] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near_of(vocab):
    letters = sorted({c for w in vocab for c in w})
    out = {}
    for w in vocab:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        tries = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        out[w] = {t for t in tries if t in vocab and t != w}
    return out


def group(vocab, factor=10):
    form, near = {}, near_of(vocab)
    for w in vocab:
        best = min(near[w], key=lambda t: (-vocab[t], t), default=None)
        form[w] = best if best is not None and vocab[best] >= factor * vocab[w] else None
    out = []
    for w, n in vocab.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def random_vocab(seed, n, alphabet, sizes):
    r = random.Random(seed)
    vocab = {}
    while len(vocab) < n:
        w = "".join(r.choice(alphabet) for _ in range(r.randint(*sizes)))
        vocab[w] = 2 + int(10 ** (4 * r.random()))
        if r.random() < 0.5:  # something near it
            at = r.randrange(len(w))
            vocab[r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(alphabet) + w[at:], w[:at] + r.choice(alphabet) + w[at + 1 :]])] = 2 + int(10 ** (4 * r.random()))
    return vocab


@pytest.mark.parametrize("vocab", [
    random_vocab(1, 300, "ab", (1, 8)), random_vocab(2, 300, "abéÿ", (5, 9)), random_vocab(3, 200, "aab", (7, 14)), {"a" * n: 10 ** (n % 4) + 1 for n in range(1, 40)}, {"": 3, "a": 40, "ab": 500}, {"single": 5},
])
def test_neighbours_against_plain_python(spark, vocab):
    df = spark.createDataFrame(list(vocab.items()), "word string, n long")
    pairs = [(r.word, r.n, r.near, r.near_n) for r in neighbours(df).collect()]
    assert sorted(pairs) == sorted((w, vocab[w], t, vocab[t]) for w, ts in near_of(vocab).items() for t in ts)  # each once
    assert rows_of(group_variants(df)) == group(vocab)


def test_chains_of_forms(spark):
    vocab = {"abcdefg" + "h" * k: 2 * 10**k for k in range(9)}
    got = rows_of(group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long")))
    assert got == group(vocab) and {r[2] for r in got} == {"abcdefghhhhhhhh"}


def test_a_prefix_of_most_words(spark, monkeypatch):
    """Nodes of many words are joined where these lie, with the same result."""
    monkeypatch.setattr(common, "LIGHT", 3)
    monkeypatch.setattr(common, "HEAVY_SHARE", 50)
    vocab = random_vocab(4, 300, "abc", (3, 6)) | {"stemstem" + w: n for w, n in random_vocab(5, 500, "abc", (1, 5)).items()}
    assert rows_of(group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long"))) == group(vocab)


def test_words_of_awkward_texts(spark):
    long = " ".join(f"wordnumber{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(40_000))
    texts = [None, "", "  ", "short ones", "Étudiant ÉTUDIANT étudiant", "con×cat÷enated naïveté", long, long, "letters1digits2between", "a\x00bcdefgh abcdefgh", "日本語 ünïcödé x" * 3, "A" * 5000 + " " + "a" * 5000, "same same same sameword SameWord"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "nothing deleted without an id"), (None, "nothing deleted without an id"), (4, texts[4])]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n int, word string").repartition(3)
    want = count_words(docs)
    assert {r.word: r.n for r in vocabulary(damaged_words(df)).collect()} == want
    assert rows_of(group_variants(vocabulary(damaged_words(df)))) == group(want)
    assert group_variants(vocabulary(damaged_words(df.limit(0)))).count() == 0
    nulls = spark.createDataFrame([(None, 3), ("wordword", 4)], "word string, n long")
    assert rows_of(group_variants(nulls)) == [("wordword", None, "wordword", 4, 0, None)]


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and dict(got.dtypes)["n_near"] == "bigint"
    assert rows_of(got) == group(count_words(docs))


def test_no_python_in_the_plan(spark):
    plan = queries.op12_spelling_variants(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)
