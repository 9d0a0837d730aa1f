"""Every operator against brute force or an exact round trip, on awkward rows and on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from hostgrain.llm import media, neardup, queries, sharding, tokencount
from hostgrain.llm.decontam import find_windows, item_digest
from hostgrain.llm.langid import ByteNet, held_out, identify_language, train_language_net, windows_of
from hostgrain.llm.linededup import drop_recurring_lines
from hostgrain.llm.mixing import fair_mix
from hostgrain.llm.neardup import components, fine_bits, most_differing, near_duplicates, registers
from hostgrain.llm.sharding import RoomTree, pack, shard_documents
from hostgrain.llm.tokencount import by_bytes, count_tokens
from hostgrain.llm.urlfilter import match_urls, rules_frame
from hostgrain.llm.words import shingle_set

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while seven grey geese watch from a cold pond near the old stone mill and nobody says a word to them at all today"
EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, BASE, "en", "b"), (5, BASE, "en", "b"), (6, BASE.upper(), "en", None), (7, BASE + " extra", "en", "a"),
    (8, BASE.replace("geese", "ducks"), "de", "c"), (9, "one", "en", "a"), (10, "One two", "en", "a"), (11, "one\ttwo", "en", "a"), (12, LONG, "fr", "a"), (13, LONG + " tail", "fr", "a"),
    (14, "é日本 😀 ünï", None, "c"), (15, "123 456 !!!", "en", "d"), (16, "same line of eight tokens number 1 here\nx", "en", "a"), (17, "same line of eight tokens number 22 here\ny", "en", "a"),
    (18, "z\nsame line of eight tokens number 333 here", "en", "a"), (19, "a\x00b c", "en", "a"),
]
COLUMNS = "doc_id long, text string, lang string, source string, size long, shard string, component_id string, n string, blob string, items string"


@pytest.fixture(scope="module")
def edge(spark):
    """Awkward rows, in columns some of which have the names that operators add."""
    return spark.createDataFrame([(*r, 1, "s", "c", "n", "b", "i") for r in EDGE], COLUMNS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


# 1

URLS = [
    None, "", "no scheme", "http://com/", "HTTP://A.Com/x", "http://x.example.com/en/1", "http://www.example.com/en/", "http://www.example.com/fr/", "http://notexample.com/en/", "http://example.com", "http://example.com?q",
    "http://b.net/es/a#t", "http://net/fr/", "http://c.org/", "http://a.com/?u=http://b.net/es/", "://h/p", "http://EXAMPLE.com/en/x?y#z", "http://example.com/en", "http://a\nb.com/x",
    "http://net\x01x/es/a", "http://x.net\x01/es/a", "http://\x00\x01\x02\x03.net/es/a", "http://a\x01.\x02com/x", "http://b\x02.a.com/x", "http://com\x00/x", "http://com\x01a/x",
]


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = brute.lower(re.split("[/?#]", rest, maxsplit=1)[0])
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[3:] if fit else (None, default)))


@pytest.mark.parametrize("rules", [queries.URL_RULES, [], [("com", "/", "block"), ("com", "/", "allow"), ("a.com", "/x", "allow"), ("example.com", "", "block")]])
def test_url_filter(spark, rules):
    df = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate([*URLS, URLS[5]])], "page_id long, url string, rule string, verdict string")
    got = match_urls(df, rules_frame(spark, rules), partitions=3).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((i, h, p, r or "", v) for i, u in enumerate([*URLS, URLS[5]]) for h, p, r, v in [judge(u, rules)])
    assert match_urls(df.limit(0), rules_frame(spark, rules)).count() == 0


def test_url_filter_on_pages(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op1_url_filter(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got[p.page_id] == judge(p.url, queries.URL_RULES)


# 2


def test_near_duplicates_on_edges(edge, empty):
    for k in (4, 5):
        want = brute.near_duplicates([r[:2] for r in EDGE], k, 80)
        got = near_duplicates(edge.unionByName(edge.filter("doc_id in (2, 5)")), k, 80).collect()
        assert len(got) == len(EDGE) + 2
        for r in got:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [neardup.BLOCK, 16])
def test_near_duplicates_in_crowds(spark, monkeypatch, block):
    """A family of near copies around one base, some too far from it, and documents that share a long passage."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(4000)]
    base = list(rng.choice(words, 150))
    passage = list(rng.choice(words, 60))
    docs = []
    for i in range(150):
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(0, 11)), replace=False):
            w[at] = f"u{i}_{at}"
        docs.append((i, " ".join(w)))
    for i in range(150, 260):
        docs.append((i, " ".join([*passage, *rng.choice(words, int(rng.integers(8, 60)))])))
    want = brute.near_duplicates(docs, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()}
    assert got == want
    assert 2 < max(Counter(c for _, c in want.values()).values()) < 150


def test_null_ids(spark):
    df = spark.createDataFrame([(None, BASE), (3, BASE), (None, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(df).collect()) == [(0, 0, True), (0, 3, False), (3, 3, True)]


def test_registers_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    a, b = registers(s[:900]), registers(s[100:])
    assert abs((a == b).mean() - 0.8) < 0.12
    assert (np.maximum(a, b) == registers(s)).all()  # sketches merge
    assert len(shingle_set(None, 4)) == 0 and len(shingle_set("a b", 4)) == 1


def test_fine_bits_let_similar_sets_through():
    rng = np.random.default_rng(8)
    s = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    bits = fine_bits(s[:900])
    differing = lambda t: int(np.bitwise_count((bits ^ fine_bits(t)).view(np.uint64)).sum())
    assert differing(s[100:]) <= most_differing(80) < differing(s[200:])
    assert differing(s[:900][::-1]) == 0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    pairs += [(5000, 5001 + i) for i in range(300)] + [(9000, 8000 + i) for i in range(300)] + [(5100, 9000)]  # hubs
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    hubs = {n: c for n, c in got.items() if n >= 5000}
    assert hubs == dict.fromkeys([*range(5000, 5301), *range(8000, 8300), 9000], 5000)
    got = {n: c for n, c in got.items() if n < 5000}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20, **{100 + i: 100 for i in range(41)}}


# 3

ITEMS = [(1, BASE), (2, None), (3, ""), (4, "one two"), (5, "!!!"), (6, "Seven grey GEESE watch, from a cold pond near the old stone mill"), (6, "one two"), (7, "one two"), (8, "é日本 ünï")]


def test_decontamination_by_an_item_of_several_batches(spark):
    """The item has more rows of shingles than are held at a time; its first, middle and last windows are found."""
    words = [f"w{i}" for i in range(5000)]
    items = spark.createDataFrame([("long", " ".join(words))], "item_id string, text string")
    docs = spark.createDataFrame([(i, "x " + " ".join(words[at : at + 10]) + " y") for i, at in enumerate((0, 2500, 3333, 4990))] + [(4, " ".join(words[4991:]))], "doc_id long, text string")
    got = {r.doc_id: (r.hits, r["items"]) for r in find_windows(docs, items).collect()}
    assert got == {**{i: (list(range(1, 11)), ["long"]) for i in range(4)}, 4: ([], [])}


def test_decontamination_on_edges(spark, edge, empty):
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, h long")
    got = find_windows(edge.unionByName(edge.filter("doc_id = 8")), items).collect()
    assert len(got) == len(EDGE) + 1
    texts = {r[0]: r[1] for r in EDGE}
    for r in got:
        n, hit, own = brute.hits(texts[r.doc_id], ITEMS)
        assert (r.n_words, set(r.hits), set(r["items"])) == (n, hit, own), r.doc_id
        assert r.hits == sorted(hit)
    assert find_windows(empty, items).count() == 0
    none = find_windows(edge, items.limit(0))
    assert none.count() == len(EDGE) and none.filter(F.size("hits") > 0).count() == 0
    digest = none.select(item_digest("items").alias("d")).distinct().collect()
    assert [r.d for r in digest] == [hashlib.sha256(b"").hexdigest()]


# 4


def test_line_dedup_on_edges(edge, empty):
    want = brute.dropped_lines([r[:2] for r in EDGE])
    got = {r.doc_id: r for r in drop_recurring_lines(edge).collect()}
    for r, lines in zip(EDGE, want, strict=True):
        assert got[r[0]].dropped == lines
        assert got[r[0]].text == (None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in lines))
    assert got[17].text == "y" and got[18].text == "z" and got[16].text == EDGE[15][1]
    assert drop_recurring_lines(empty).count() == 0
    again = drop_recurring_lines(edge.unionByName(edge.filter("doc_id = 18"))).filter("doc_id = 18").collect()
    assert [r.text for r in again] == ["z", "z"]


def test_line_dedup_of_short_lines_and_number_tables(spark):
    rows = [(1, "a one\nAll rights reserved.\n1 2 3 4 5 6 7 8\n\n同じ行です。"), (2, "b two\nAll rights reserved.\n9 8 7 6 5 4 3 2\n\n同じ行です。")]
    got = {r.doc_id: r.dropped for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [1, 4]}


NAMES = ["alice", "bob", "carol", "dave", "erin", "frank"]
LOGS = [
    *((i, f"text {i}\nuser {name} logged in from the main office today") for i, name in enumerate(NAMES)),
    *((10 + i, f"user alice logged in from the main office today\nrow {i} x{i * i}") for i in range(3)),
    (20, "Posted by Anna in Berlin under news and weather today"), (21, "Posted by Omar in Paris under news and weather today\n"), (22, "Posted by Kim in Rome with all her own photographs inside"),
    (23, "short line of seven plain tokens a"), (24, "short line of seven plain tokens b"), (25, "12 13 14 15 16 17 and 18 19 20"), (26, "22 23 24 25 26 27 and 28 29 20"),
    (27, "  total of rows: 17 in table\t\r\n"), (28, "total of rows: 4 in table\nx y z in a long line of its own that nobody else has at all"),
]


def test_templates_have_fields_without_digits(spark):
    df = spark.createDataFrame(LOGS, "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in drop_recurring_lines(df).collect()}
    want = dict(zip((d for d, _ in LOGS), brute.dropped_lines(LOGS), strict=True))
    assert got == want
    assert [got[i] for i in range(6)] == [[], *[[1]] * 5] and [got[i] for i in (10, 11, 12)] == [[0]] * 3  # one template, whoever logged in
    assert got[21] == [0] and got[22] == [] and got[24] == [0] and got[26] == [] and got[28] == [0]
    deep = {r.doc_id: r.dropped for r in drop_recurring_lines(df, depth=3).collect()}
    assert deep == dict(zip((d for d, _ in LOGS), brute.dropped_lines(LOGS, depth=3), strict=True))
    assert deep[1] == [] and deep[10] == [0]  # the name is a leading token now, and so leads to other leaves


def test_fields_anywhere_in_a_long_line_or_in_a_short_one(spark):
    """Four fields of 40 tokens, one in each quarter; and four names in lines of seven tokens."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    spread = [(i, " ".join([*words[:5], f"v{'x' * i}a", *words[6:15], f"v{'y' * i}b", *words[16:25], f"v{'z' * i}c", *words[26:35], f"v{'u' * i}d", *words[36:]])) for i in range(8)]
    names = [(20 + i, f"user {name} logged in from main office") for i, name in enumerate(NAMES[:4])]
    rows = [*spread, *names]
    got = {r.doc_id: r.dropped for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip((d for d, _ in rows), brute.dropped_lines(rows), strict=True))
    assert [got[i] for i in range(8)] == [[], *[[0]] * 7] and [got[20 + i] for i in range(4)] == [[], *[[0]] * 3]


def test_line_dedup_of_long_texts_with_many_dropped_lines(spark):
    shared = [f"a shared line with the words w{'x' * (i % 7)} and {chr(97 + i % 26) * (3 + i // 26)} in it" for i in range(20_000)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["first", *shared, "last"])), (3, None), (4, "")]
    got = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].dropped == [] and got[2].dropped == list(range(1, 20_001)) and got[2].text == "first\nlast"
    assert got[3].text is None and (got[4].text, got[4].n_lines) == ("", 1)


def test_line_dedup_on_documents(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r.dropped_lines for r in queries.op4_line_dedup(spark, SF).collect()}
    for (d, _), lines in zip(docs, brute.dropped_lines(docs), strict=True):
        assert got[d] == ",".join(map(str, lines))


# 6


def payload_digest(text):
    """Size, padded size, digest and checksum of the last bytes of a text's payload, apart from any stream."""
    raw = (text or "").encode()
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_media_on_edges(edge, empty):
    got = {r.doc_id: r for r in media.digest(media.from_streams(media.to_streams(edge))).collect()}
    for d, t, *_ in EDGE:
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == payload_digest(t)
        assert r.media_bytes % media.PACKET == 0 and "continuity_errors=0;damaged=0" in r.feature
    assert got[4].media_sha256 == got[5].media_sha256 != got[6].media_sha256
    assert media.digest(media.from_streams(media.to_streams(empty))).count() == 0


def test_damaged_streams():
    payload = bytes(range(256)) * 600
    whole = media.write_stream(payload)
    assert media.read_stream(whole)[0] == payload
    cut_out = whole[: media.PACKET * 9] + whole[media.PACKET * 10 :]
    _, units, errors, damaged = media.read_stream(cut_out)
    assert errors == 1 and damaged == 1 and len(units) == len(media.read_stream(whole)[1]) - 1
    assert media.read_stream(b"junk")[1] == [] and media.read_stream(media.write_stream(payload[:64])[media.PACKET * 2 :])[1] == []  # no tables
    units = media.read_stream(whole)[1]
    assert [u[3] for u in units] == [i % media.UNITS_BETWEEN_POINTS == 0 for i in range(len(units))]
    assert [u[0] for u in units] == [i * media.TICKS for i in range(len(units))]


# 7


def check_shards(rows, docs, shards):
    by = defaultdict(set)
    for r in rows:
        by[docs[r.doc_id]].add(r.shard)
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert all(len(s) == 1 for s in by.values())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_sharding_on_edges(edge, empty):
    rows = shard_documents(edge.unionByName(edge.filter("doc_id in (1, 9)")), 4).collect()
    assert len(rows) == len(EDGE) + 2
    check_shards(rows, {r[0]: r[1] for r in EDGE}, 4)
    assert shard_documents(empty, 4).count() == 0


def test_sharding_is_even(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op7_sharding(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, docs, 8)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert len(load) == 8 and max(load.values()) < 1.002 * sum(load.values()) / 8


def test_sharding_packs_all_groups_best_fit_decreasing(spark, monkeypatch):
    """Sizes per shard are those of a plain best fit decreasing over all groups, with a list for the tree."""
    monkeypatch.setattr(sharding, "PER_BUCKET", 3)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    group = Counter()
    for t in docs.values():
        group[t] += len((t or "").encode()) + 1
    left = [-(-sum(group.values()) // 8)] * 8
    want = []
    for n in sorted(group.values(), reverse=True):
        k = min(((r, k) for k, r in enumerate(left) if r >= n), default=None) or max((r, k) for k, r in enumerate(left))
        left[k[1]] -= n
        want.append((n, k[1]))
    got = {docs[r.doc_id]: r.shard for r in queries.op7_sharding(spark, "/root/testdata/sf0.01").collect()}
    assert sorted((group[t], k) for t, k in got.items()) == sorted(want)


def test_packing_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        groups = [(int(s), f"g{i}") for i, s in enumerate(rng.integers(1, 1000, int(rng.integers(1, 400))))]
        n, total = int(rng.integers(1, 9)), sum(s for s, _ in groups)
        placed, room = pack(groups, n, total)
        # The same rule with a plain list for the tree.
        order = sorted(groups, key=lambda g: (-g[0], g[1]))
        over, rest = 0, total
        while over < min(len(order), n - 1) and order[over][0] * (n - over) > rest:
            rest -= order[over][0]
            over += 1
        level = -(-rest // (n - over))
        left = [0] * over + [level] * (n - over)
        for i, (s, g) in enumerate(order):
            if i >= over:
                fit = [(left[k], k) for k in range(over, n) if left[k] >= s]
                k = min(fit)[1] if fit else max((left[k], k) for k in range(over, n))[1]
                left[k] -= s
                assert placed[g] == k
            else:
                assert placed[g] == i
        assert room == left
    big = [(700, "big")] + [(10, f"s{i}") for i in range(30)]
    placed, room = pack(big, 4, 1000)
    assert placed["big"] == 0 and sorted(Counter(placed.values()).values()) == [1, 10, 10, 10]


def test_room_tree():
    rng = np.random.default_rng(2)
    rooms = {k: int(r) for k, r in enumerate(rng.integers(0, 500, 700))}
    tree = RoomTree([(r, k) for k, r in rooms.items()])
    for _ in range(2000):
        size = int(rng.integers(0, 520))
        fit = [(r, k) for k, r in rooms.items() if r >= size]
        assert tree.tightest(size) == (min(fit) if fit else None)
        assert tree.largest() == max((r, k) for k, r in rooms.items())
        k = int(rng.integers(0, 700))
        new = int(rng.integers(-20, 500))
        tree.move((rooms[k], k), new)
        rooms[k] = new


# 8


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, edge, empty, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate([" a", "a  b", "<s> </s>", "a <|endoftext|> b", "▁x ▁", "x▁ y", "　a b c", "a \n b", "  ", "x" * 5000 + " " + "y" * 5000])], "doc_id long, text string")
    for r in count_tokens(edge.select("doc_id", "text").unionByName(odd), path, limit=100).join(edge.select("doc_id", "text").unionByName(odd), "doc_id").collect():
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), count(r.text or "")), r.doc_id
        assert r.over_limit == (r.n_tokens > 100)
    assert count_tokens(empty, path).count() == 0


def test_batches_go_by_bytes():
    runs = list(by_bytes(["日本" * 20, "x" * 100, "é" * 30, "y" * 300, "", "z"], 200))
    assert runs == [["日本" * 20], ["x" * 100, "é" * 30], ["y" * 300], ["", "z"]]


def test_long_texts_are_split_safely(spark, monkeypatch):
    """Texts without spaces, in parts of 20 characters and more: of scripts in and out of the vocabulary, of letters that merge."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(tokencount, "LONG", 20)
    rng = np.random.default_rng(4)
    alphabets = ["日本語の文章数据获取一个", "ภาษาไทย", "abcdefghij", "a\n\tb日é😀x", "한국어문장", "e\u0301ａ１２３", "▁a日 \n"]
    texts = ["".join(rng.choice(list(x), int(rng.integers(15, 400)))) for x in alphabets for _ in range(30)]
    count = tokencount._piece_counter(path)
    assert [count([t])[0] for t in texts] == [len(model.encode(t)) for t in texts]
    assert count(texts) == [len(model.encode(t)) for t in texts]


def test_token_counts_of_documents(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in queries.op8_token_count(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert got[d.doc_id] == len(model.encode(d.text or ""))


# 9


def test_mixing_on_edges(edge, empty):
    docs = [(r[0], len(re.findall(brute.SPACES, r[1] or "")), r[3]) for r in EDGE]
    want = brute.targets([(s, n) for _, n, s in docs], [3, 1, 2], 1.5, 2)
    rows = fair_mix(edge, [3, 1, 2], 1.5).collect()
    assert sorted((r.doc_id, r.size, r.source or "") for r in rows) == sorted((d, n, s or "") for d, n, s in docs)
    for r in rows:
        assert r.source_size == want[r.source][0] and r.target == pytest.approx(want[r.source][1])
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
    assert rows == fair_mix(edge.repartition(7), [3, 1, 2], 1.5).collect() or sorted(rows) == sorted(fair_mix(edge.repartition(7), [3, 1, 2], 1.5).collect())
    assert fair_mix(empty, [3, 1, 2], 1.5).count() == 0


def test_mixing_meets_targets(spark):
    rows = fair_mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), **queries.MIX).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    assert sum(taken.values()) <= 1.5 * sum(r.size for r in rows)
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * largest[s]


# 10


def test_language_on_edges(spark, edge, empty):
    net = ByteNet(["a", "b"])
    rows = {r.doc_id: r for r in identify_language(edge, net, keep=("source", "blob")).collect()}
    assert len(rows) == len(EDGE)
    for d in (1, 2, 3, 15):
        assert (rows[d].lang_pred, rows[d].score) == ("und", 0.0)
    assert rows[14].lang_pred in ("a", "b") and 0 < rows[14].score <= 1 and rows[4].score == rows[5].score
    assert identify_language(empty, net).count() == 0
    assert {r.lang_pred for r in identify_language(edge, None).collect()} == {"und"}
    assert train_language_net(empty) is None
    assert train_language_net(edge.filter("doc_id in (1, 2, 3, 15)")) is None


def test_scores_do_not_depend_on_partitions(spark, edge):
    """Texts of one to many windows, in company of others or alone."""
    net = ByteNet(["a", "b", "c"])
    docs = edge.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, BASE * (i % 9 + 1) + str(i % 13)) for i in range(200)], "doc_id long, text string"))
    runs = [{(r.doc_id, r.lang_pred, r.score) for r in identify_language(docs.repartition(n, F.xxhash64("doc_id", F.lit(n))), net).collect()} for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == docs.count()


def test_scorer_is_the_network():
    """The scorer's pair tables give what the plain filters give."""
    net = ByteNet(["a", "b", "c"])
    x = windows_of(("Ünïcödé text, " * 100).encode())
    hidden = np.maximum(np.concatenate([m.max(1) for m in net._maps(x)], 1), 0)
    z = hidden @ net.dense + net.offset
    want = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(net.scorer()(x), want, atol=1e-5)


def test_language_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert {r.doc_id for r in got} == {d.doc_id for d in docs.select("doc_id").collect() if zlib.crc32(str(d.doc_id).encode()) % 4 == 2}
    assert docs.filter(held_out("doc_id")).count() == len(got)


def test_parts_of_lines_are_shuffled_once(spark, monkeypatch):
    from hostgrain.llm import linededup

    # Part 0 is heavy and shared, 1 heavy and of one line, 2 light and shared; the others are of one line each.
    rows = [(e1, [0]) for e1 in range(40)] + [(100, [1, 2])] * 40 + [(101, [2]), (102, [3])] + [(103, [4])] * 2
    lines = spark.createDataFrame([(e1, parts, n, 0) for n, (e1, parts) in enumerate(rows)], "_e1 long, _parts array<long>, _r long, line int")
    want = {*range(40), 100, 101}
    assert {r._e1 for r in linededup._varying(lines).collect()} == want
    plan = linededup._varying(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1, "one pass over the parts"
    monkeypatch.setattr(linededup, "DRAWN", 1)
    found = linededup._varying(lines)
    assert sorted(r._e1 for r in found.collect()) == sorted(want)


def test_rows_of_heavy_parts_pass_one_kind_of_join(spark, monkeypatch):
    """Joins of parts give each row once, whatever its part holds: what a heavy part's lines share goes by a flag."""
    from hostgrain.llm import linededup

    monkeypatch.setattr(linededup, "DRAWN", 1)
    for heavy in ([(e1, [0, 1]) for e1 in range(40)], [(7, [0])] * 40):
        rows = [*heavy, (100, [2]), (101, [2]), (102, [3])]
        lines = spark.createDataFrame([(e1, parts, n, 0) for n, (e1, parts) in enumerate(rows)], "_e1 long, _parts array<long>, _r long, line int")
        found = linededup._varying(lines)
        assert sorted(r._e1 for r in found.collect()) == [*(range(40) if len(heavy[0][1]) > 1 else ()), 100, 101]
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("Join LeftOuter") > 0


def test_parts_of_all_lines_are_gone_once_they_are_compared(spark):
    from hostgrain.llm import common

    written = common.cuts_written()
    got = {r.doc_id: r.dropped for r in drop_recurring_lines(spark.createDataFrame(LOGS, "doc_id long, text string")).collect()}
    assert got == dict(zip((d for d, _ in LOGS), brute.dropped_lines(LOGS), strict=True))
    from hostgrain.operators import store

    assert all("_parts" not in spark.read.parquet(path).columns for path in store._written[written:])


def test_tokens_between_any_blanks(spark):
    from hostgrain.llm import linededup

    lines = ["a b", "a  b", "a\tb\x0b\x0cc", " \t a b1 2c\r", "x\r\ry z9\t", "", "\xa0a  1 b", "1", "a1b\t\t3 c  d", "\x1ca \x1d2"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    got = {r.i: r.t for r in df.select("i", linededup.tokens_of(linededup.stripped(df.s)).alias("t")).collect()}
    words = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]
    assert got == {i: [linededup.WILD if re.search("[0-9]", w) else w for w in words(s)] for i, s in enumerate(lines)}
