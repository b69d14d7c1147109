"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusops.llm import decontamination, langid, lm, nearest, packing, quality, repair, sentencepieces, simhash, suffixes, toxicity, tries, warc
from nimbusops.session import Staging, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL for the rows of a query, where SQL can state them on whole tables.
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


PIECE_MODEL = "piece_bpe_32k.model"


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))
    return sentencepieces.digests(encoded)


@query
def op6_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


SQL["op6_vector_approximation"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


SQL["op4_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN sizes ON i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, p.n, item FROM p JOIN win ON p.win = win.win AND p.n = win.n),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def crc_class(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5


@query
def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, crc_class() != 0)
    return langid.predict(docs, model).select("doc_id", (crc_class() == 0).alias("held_out"), "lang_pred", "score")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return warc.round_trip(pages, least_bytes=0).select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per packed row: what it holds and the digest of its ids as read back from the shard files."""
    staging = Staging(spark)
    folder = f"{staging.path}/shards"
    docs = table(spark, sf_dir, "documents")
    index = staging.write("index", packing.write(docs, folder, public_tokenizers.path(PIECE_MODEL)))
    return packing.read(index, folder).select(
        "doc_ids", "parts", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


@query
def op3_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), crc_class() == 1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op5_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS v FROM d),
b AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(v, lambda x: substr(a, CAST((x // 32768) % 32 + 1 AS BIGINT), 1) || substr(a, CAST((x // 1024) % 32 + 1 AS BIGINT), 1)
        || substr(a, CAST((x // 32) % 32 + 1 AS BIGINT), 1) || substr(a, CAST(x % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
    if(page_id = first, 'response', 'revisit') AS record_type, if(page_id = first, NULL, first) AS refers_to
FROM v, b
"""

SQL["op7_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS part FROM (SELECT doc_id, h, unnest(range(n - 99)) AS p FROM d WHERE n >= 100)),
f AS (SELECT part, min(doc_id) AS doc_id, arg_min(p, (doc_id, p)) AS p FROM s GROUP BY part HAVING count(*) > 1),
g AS (SELECT s.doc_id, s.p FROM s JOIN f USING (part) WHERE (s.doc_id, s.p) <> (f.doc_id, f.p)),
r AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 100 AS new FROM g),
e AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b, row_number() OVER (PARTITION BY doc_id ORDER BY min(p)) AS i
    FROM (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r) GROUP BY doc_id, run),
k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM (
    SELECT d.doc_id, h, coalesce(x.b, 0) AS a, coalesce(y.a, n) AS b
    FROM d JOIN (SELECT doc_id, b, i FROM e UNION ALL SELECT doc_id, 0, 0 FROM d) x USING (doc_id)
    LEFT JOIN e y ON y.doc_id = d.doc_id AND y.i = x.i + 1) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM e GROUP BY 1) USING (doc_id)
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations start with up to five turns of the first conversation of their hundred."""
    listed = Staging(spark).write("turns", tries.turns(table(spark, sf_dir, "conversations")))
    conv_id = F.col("conv_id")
    head = F.pmod(F.crc32(conv_id.cast("string")), F.lit(6)).cast("int")
    return tries.prefix_trie(tries.with_heads(listed, conv_id - conv_id % 100, head, 5))


#: The unsigned CRC-32 of the ASCII text that stands for {}.
CRC32 = """xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295))"""

SQL["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY p) AS l FROM t GROUP BY 1),
h AS (SELECT conv_id, l, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM l),
s AS (SELECT h.conv_id, list_concat(coalesce(b.l[1:h], []), h.l[h + 1:]) AS l FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(l) AS n, d, sha256(CAST(l[1:d] AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(l[1:d - 1] AS VARCHAR)) END AS up,
    CASE WHEN d > 0 THEN length(l[d].x) ELSE 0 END AS c FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM s)),
e AS (SELECT d, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * min(c) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM e WHERE d > 0 GROUP BY ALL),
w AS (SELECT e.d, e.k, e.conv_id, e.saved, coalesce(kids.n, 0) AS kids FROM e LEFT JOIN kids USING (d, k)),
below AS (SELECT m.d, m.k, sum(w.saved) AS saved, count(*) FILTER (w.kids = 0) AS leaves FROM w
    JOIN m ON m.conv_id = w.conv_id AND m.d <= w.d GROUP BY m.d, m.k)
SELECT e.conv_id, e.d AS depth, u.conv_id AS parent_conv_id, e.n AS n_convs, w.kids AS n_children, leaves AS n_leaves,
    CAST(below.saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN w USING (d, k) JOIN below USING (d, k) LEFT JOIN e u ON u.d = e.d - 1 AND u.k = e.up
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a faulty source would give them, by the checksum of id and turn: `damage` 0 is lost, 1 is
    empty, 2 has no sentence ends, 3 comes twice, 4 is a user turn. Nulls become one space."""
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    damage = F.pmod(F.crc32(F.concat_ws(":", conv_id, turn)), F.lit(20)).cast("int")
    return conversations.select("conv_id", "turn", damage.alias("damage"), role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", "damage", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, turns = repair.repair(damaged(table(spark, sf_dir, "conversations")), F.col("damage") != 0)
    same = repair.repaired_digests(turns).withColumnRenamed("conv_id", "same_id")
    return found.join(same, F.col("conv_id").eqNullSafe(F.col("same_id"))).drop("same_id")


SQL["op12_structure_repair"] = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
g AS (SELECT conv_id, turn, if(k = 4, 'user', role) AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(if(k = 3, 2, 1))) AS copy FROM o WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || ':' || text)) AS i,
    rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS tail FROM g),
f AS (SELECT conv_id, turn, role, text, i, strpos('sua', left(role, 1)) * (role <> '')::INTEGER AS r, CASE WHEN tail = '' THEN 1
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM n),
p AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank,
    count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (i > 1 AND before * 10 + r NOT IN (12, 23, 32)) AS illegal, count(*) AS n FROM p GROUP BY 1),
dp AS (SELECT conv_id, 0 AS i, (0, '') AS c0, (999999999, '') AS c1, (5, 'I') AS c2, (10, 'II') AS c3 FROM sums
    UNION ALL
    SELECT conv_id, i, c0, c1, least(c2, (c0[1] + 5, c0[2] || 'I'), (c1[1] + 5, c1[2] || 'I'), (c3[1] + 5, c3[2] || 'I')) AS d2,
        least(c3, (c2[1] + 5, c2[2] || 'I'), (c0[1] + 10, c0[2] || 'II'), (c1[1] + 10, c1[2] || 'II')) FROM (
    SELECT dp.conv_id, f.i, (c0[1] + 2, c0[2] || 'D') AS c0,
        least((c1[1] + 2, c1[2] || 'D'), if(r = 1 AND f IN (0, 3), (c0[1] + w, c0[2] || 'K'), (999999999, ''))) AS c1,
        least((c2[1] + 2, c2[2] || 'D'), if(f IN (0, 3), least((c0[1] + w + e2, c0[2] || l2), (c1[1] + w + e2, c1[2] || l2),
            (c3[1] + w + e2, c3[2] || l2)), (999999999, ''))) AS c2,
        least((c3[1] + 2, c3[2] || 'D'), if(f IN (0, 3), (c2[1] + w + e3, c2[2] || l3), (999999999, ''))) AS c3
    FROM dp JOIN (SELECT *, if(f = 3, 5, 0) AS w, if(r = 2, 0, 1) AS e2, if(r = 2, 'K', 'R') AS l2, if(r = 3, 0, 1) AS e3, if(r = 3, 'K', 'R') AS l3 FROM f) f
        ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)),
best AS (SELECT sums.conv_id, least(c0, c3) AS c FROM sums JOIN dp ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.i = sums.n),
l AS (SELECT conv_id, j, substr(c[2], j, 1) AS letter, j - length(replace(substr(c[2], 1, j), 'I', '')) AS ins, length(replace(substr(c[2], 1, j), 'D', '')) AS pos
    FROM (SELECT conv_id, c, unnest(range(1, length(c[2]) + 1)) AS j FROM best)),
k AS (SELECT l.conv_id, j, letter, pos, f.role, f.text, max(CASE WHEN letter = 'K' AND pos = 1 AND r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
    FROM l LEFT JOIN f ON letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = j - ins),
made AS (SELECT conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role ELSE if((pos - s) % 2 = 1, 'user', 'assistant') END || ':'
    || if(letter = 'I', '', text), chr(10) ORDER BY j)) AS h FROM k WHERE letter <> 'D' GROUP BY 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(c[1], 0) AS BIGINT) AS cost, coalesce(c[2], '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM every LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM every.conv_id
LEFT JOIN made ON made.conv_id IS NOT DISTINCT FROM every.conv_id
"""


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), crc_class() != 0))
    return scored.select("doc_id", (crc_class() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
