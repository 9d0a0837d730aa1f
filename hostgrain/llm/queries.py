"""The registered queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from .common import cut, scratch, table
from .decontam import find_windows, item_digest
from .langid import held_out, identify_language, train_language_net
from .linededup import drop_recurring_lines
from .media import digest, from_streams, to_streams
from .mixing import fair_mix
from .neardup import near_duplicates
from .secrets import RULES, joined_spans, scan_into
from .sharding import shard_documents
from .spelling import damaged_words, group_variants, vocabulary
from .tokencount import count_tokens
from .toxicity import held_out as toxicity_held_out, score_toxicity, train_toxicity
from .urlfilter import match_urls, rules_frame
from .vectorcodes import compress_vectors, digest as codebooks_digest, with_group_error

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return match_urls(pages, rules_frame(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT page_id, host, path, max(struct_pack(n := length(rhost) + length(rpath), rule := rhost || rpath, verdict := verdict)) AS b
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best
"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.reached) AS component_id, d.doc_id = min(r.reached) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        item_digest("items").alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS x
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", F.size("dropped").alias("n_dropped"), F.array_join(F.transform("dropped", lambda n: n.cast("string")), ",").alias("dropped_lines"),
        F.sha2("text", 256).alias("text_sha256"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
m AS (SELECT doc_id, text, i, trim(line, e' \t\x0b\x0c\r') AS s FROM l),
g AS (
  SELECT doc_id, text, i, regexp_split_to_array(regexp_replace(s, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+') AS t
  FROM m WHERE strlen(s) >= 16),
e AS (SELECT *, len(t) AS n, len(list_filter(t, lambda x: x = '<*>')) AS wild FROM g),
c AS (SELECT t, n, wild, count(DISTINCT text) AS texts FROM e WHERE 2 * wild <= n GROUP BY ALL),
q AS (SELECT t, n, texts, q, t[q * n // (n // 5 + 1) + 1 : (q + 1) * n // (n // 5 + 1)] AS part FROM (SELECT *, unnest(range(n // 5 + 1)) AS q FROM c)),
r AS (SELECT n, t[1] AS first, q, part FROM q WHERE n >= 5 GROUP BY ALL HAVING count(DISTINCT t) > 1),
k AS (SELECT DISTINCT c.t, c.n, c.wild, c.texts FROM c JOIN q ON c.t = q.t JOIN r ON q.n = r.n AND q.t[1] = r.first AND q.q = r.q AND q.part = r.part),
p AS (SELECT t, n, wild, texts, unnest(t) AS x, unnest(range(1, n + 1)) AS p FROM k),
f AS (SELECT n, t[1] AS first, p, x, sum(texts) AS seen FROM p WHERE x <> '<*>' GROUP BY ALL),
w AS (SELECT p.t, p.n, p.wild, list(coalesce(f.seen, 0) ORDER BY p.p) AS seen
      FROM p LEFT JOIN f ON p.n = f.n AND p.t[1] = f.first AND p.p = f.p AND p.x = f.x GROUP BY ALL),
u AS (SELECT *, list_reverse_sort(seen)[greatest((n + 1) // 2, n - wild - n // 5)] AS level FROM w),
v AS (
  SELECT t, true AS varies, list_transform(list_zip(t, seen), lambda z: CASE WHEN z[2] >= 2 AND 2 * z[2] >= level THEN z[1] ELSE '<*>' END) AS template FROM u WHERE level >= 2
  UNION ALL SELECT t, false, t FROM c WHERE t NOT IN (SELECT t FROM k)),
o AS (SELECT varies, template, min(doc_id) AS keeps FROM e JOIN v ON e.t = v.t GROUP BY ALL HAVING count(DISTINCT text) >= 2),
h AS (SELECT e.doc_id, list(e.i ORDER BY e.i) AS dropped FROM e JOIN v ON e.t = v.t JOIN o ON v.template = o.template AND v.varies = o.varies WHERE e.doc_id <> o.keeps GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::INTEGER AS n_lines,
       coalesce(len(dropped), 0)::INTEGER AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped_lines,
       sha256(CASE WHEN dropped IS NULL THEN text
         ELSE array_to_string(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda x: NOT list_contains(dropped, x[2])), lambda x: x[1]), chr(10)) END) AS text_sha256
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found = scan_into(docs, scratch(spark))  # a ledger of its own, empty at first
    kinds = [r.kind for r in RULES]
    out = found.withColumn("spans", joined_spans(kinds))
    return out.select(F.col("path").alias("doc_id"), *(F.size(k).cast("long").alias(f"n_{k}") for k in kinds), F.sha2("spans", 256).alias("base_sha256"), "spans")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(from_streams(to_streams(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MIX = {"weights": [3, 1, 2], "share": 1.5, "passes": 2}


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fair_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), **MIX)
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w
      FROM d GROUP BY source),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2.0::DOUBLE * source_size) OVER f, 0) AS filled, sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS left_w
  FROM s WINDOW f AS (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size::BIGINT AS source_size, budget,
         least(cap, w * (SELECT min_by((budget - filled) / left_w, cap / w) FROM l WHERE cap > w * ((budget - filled) / left_w))) AS target
  FROM l),
c AS (
  SELECT doc_id, h, size, t.source_size, t.target, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, k, sum(size) OVER (ORDER BY (cum + source_size * k)::DOUBLE / target, h, doc_id, k, size ROWS UNBOUNDED PRECEDING) AS run
  FROM c, (VALUES (0), (1)) AS p(k) WHERE size > 0),
g AS (SELECT doc_id, h, size, cum, source_size, count(*) AS n FROM e WHERE run <= round(budget) GROUP BY ALL)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(g.n, 0) * c.size AS taken
FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.cum = g.cum AND c.size = g.size AND c.source_size = g.source_size
"""

def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train_language_net(docs.filter(~held_out("doc_id")))
    out = identify_language(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~toxicity_held_out("doc_id"))
    out = score_toxicity(docs, train_toxicity(docs, labels))
    return out.select("doc_id", toxicity_held_out("doc_id").alias("held_out"), "score", "predicted")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(vocabulary(damaged_words(table(spark, sf_dir, "documents").select("doc_id", "text"))))


#: CRC-32 byte by byte: the table's entry of a byte is the sum of those of its bits.
_CRC_BITS = [0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320]
_CRC_STEP = "c >> 8"
for _i, _v in enumerate(_CRC_BITS):
    _CRC_STEP = f"xor({_CRC_STEP}, ((xor(c, b) >> {_i}) & 1) * {_v})"
OP12_SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7),
d AS (SELECT doc_id, run, count(*) AS times FROM r GROUP BY ALL),
y AS (
  SELECT *, list_prepend(4294967295::BIGINT, list_concat(
    list_transform(string_split(doc_id::VARCHAR || ':', ''), lambda x: unicode(x)::BIGINT),
    flatten(list_transform(string_split(run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END)))) AS b
  FROM d),
h AS (SELECT run, times, xor(list_reduce(b, lambda c, b: {_CRC_STEP}), 4294967295::BIGINT) AS h, length(run) AS n FROM y),
w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % n)::BIGINT) || substr(run, (h % n)::BIGINT + 2) ELSE run END AS word, times FROM h),
v AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
x AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word FROM x JOIN v ON x.less = v.word
  UNION SELECT v.word, x.word FROM x JOIN v ON x.less = v.word),
g AS (SELECT a, count(*) AS n_near, max(v.n) AS most, arg_min(b, struct_pack(n := -v.n, b := encode(b))) AS best FROM p JOIN v ON p.b = v.word GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN best END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n FROM v LEFT JOIN g ON word = a),
t(word, reached) AS (SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON t.reached = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, t.reached AS root, f.n, f.n_near, f.form_n
FROM f JOIN t ON f.word = t.word JOIN f e ON t.reached = e.word WHERE e.form IS NULL
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=("label",))
    out = with_group_error(cut(coded), "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    nearest = """
a{i} AS MATERIALIZED (
  SELECT id, p.q, any_value(p.s) AS s, min(struct_pack(d := list_sum(list_transform(list_zip(p.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := c.e)) AS b
  FROM p JOIN c{i} c ON p.q = c.q GROUP BY id, p.q)"""
    average = """
c{j} AS MATERIALIZED (
  SELECT c.q, c.e, coalesce(m.s, c.s) AS s
  FROM c{i} c LEFT JOIN (
    SELECT q, e, list(floor(total::DOUBLE / n)::BIGINT ORDER BY i) AS s
    FROM (SELECT q, b.e AS e, i, sum(s[i]) AS total, count(*) AS n FROM a{i}, w, range(1, w.w + 1) AS r(i) GROUP BY ALL) GROUP BY q, e) m
  ON c.q = m.q AND c.e = m.e)"""
    steps = [(nearest + "," + average).format(i=i, j=i + 1) for i in range(rounds)] + [nearest.format(i=rounds)]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT max(len(v)) // {parts} AS w FROM k),
p AS MATERIALIZED (SELECT id, q, v[q * w + 1 : q * w + w] AS s FROM k, w, range({parts}) AS r(q)),
c0 AS MATERIALIZED (SELECT q, id - 1 AS e, s FROM p WHERE id <= {entries}),
{",".join(steps)},
f AS (SELECT id, string_agg(printf('%02x', b.e), '' ORDER BY q) AS code, sum(b.d)::BIGINT AS error FROM a{rounds} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY q, e)) FROM c{rounds}) AS codebooks_sha256
FROM f JOIN k ON f.id = k.id
"""


OP13_SQL = _op13_sql()


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_media": op6_media,
    "op7_sharding": op7_sharding,
    "op8_token_count": op8_token_count,
    "op9_source_mix": op9_source_mix,
    "op10_language": op10_language,
    "op11_toxicity": op11_toxicity,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {"op1_url_filter": OP1_SQL, "op2_near_duplicates": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_line_dedup": OP4_SQL, "op9_source_mix": OP9_SQL, "op12_spelling_variants": OP12_SQL, "op13_vector_codes": OP13_SQL}
