"""The registered query of each operator, over its whole table, with SQL where DuckDB can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, collocations, hnsw, manifest, merkle, neardup, packing, pii, quality, substring, toxicity, warc
from tessera.llm.text import ship


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def bpe_query(spark, sf_dir):
    return bpe.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def toxicity_query(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), "toxic", _remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def packing_query(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def neardup_query(spark, sf_dir):
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(docs, labels, "quality", _remainder(4) != 2)


def quality_query(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = quality_model(docs, _read(spark, sf_dir, "labels"))
    return quality.score(docs, model, 0.7).select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def pii_query(spark, sf_dir):
    found = pii.find(_read(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
                        F.sha2(pii.span_string("base"), 256).alias("base_sha256"), pii.span_string("spans").alias("spans"))


def substring_query(spark, sf_dir):
    return substring.deduplicate(_read(spark, sf_dir, "documents"), texts=False)


def merkle_query(spark, sf_dir):
    return merkle.fingerprints(_read(spark, sf_dir, "documents"))


def chat_query(spark, sf_dir):
    turns = chat.canonical_turns(_read(spark, sf_dir, "conversations"))
    control = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, [("user", control), ("assistant", control)])],
                                 "conv_id long, messages array<struct<role:string,content:string>>")
    return chat.read_back(chat.format_turns(turns.unionByName(chat.canonical_turns(more))))


def hnsw_query(spark, sf_dir):
    return hnsw.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def warc_query(spark, sf_dir):
    return warc.archived(_read(spark, sf_dir, "pages"))


def collocations_query(spark, sf_dir):
    return collocations.mine(_read(spark, sf_dir, "documents"))


def manifest_query(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    rows = manifest.verify(docs, manifest.without_line_ends(docs))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

NEARDUP_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS a
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
    ELSE list_distinct([array_to_string(a[i:i + 4], ' ') FOR i IN range(1, len(a) - 3)]) END AS g
  FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT l.doc_id AS a, r.doc_id AS b, any_value(l.n) AS na, any_value(r.n) AS nb, count(*) AS c
  FROM e l JOIN e r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY l.doc_id, r.doc_id),
link AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON s.doc_id = c.a"""

SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS a FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(a) - 33)) AS i, a FROM w WHERE len(a) >= 35),
h AS (SELECT doc_id, i, array_to_string(a[i:i + 34], ' ') AS x FROM s),
r AS (SELECT doc_id, i FROM h WHERE x IN (SELECT x FROM h GROUP BY x HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
word AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS x FROM w),
kept AS (
  SELECT word.doc_id, count(*) AS n, string_agg(word.x, ' ' ORDER BY word.k) AS t
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id)
SELECT w.doc_id, len(w.a)::BIGINT AS n_words, (len(w.a) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(role, '[\\\\<\\[]', '..', 'g')) + length(regexp_replace(text, '[\\\\<\\[]', '..', 'g'))
    + 23 AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT *, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first, list_transform(range(32), lambda i: 5 * i // 4 + 1) AS digit,
    '0123456789abcdef' AS hex FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(digit, lambda k, i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((strpos(hex, x[k]) - 1) * 16 + strpos(hex, x[k + 1]) - 1) >> (3 - 5 * (i - 1) % 4)) & 31) + 1, 1)),
    '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""

COLLOCATION_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS a FROM piece),
g AS (
  SELECT lang, array_to_string(list_slice(a, i, i + k - 1), ' ') AS phrase, k
  FROM (SELECT lang, a, k, unnest(range(1, len(a) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k >= 2 AND f >= 30),
cut AS (SELECT lang, phrase, a, s, unnest(range(1, k)) AS i FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, a, i, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(s[:i], ' ')
    JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(s[i + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
around AS (
  SELECT lang, array_to_string(list_slice(s, i, i + m - 1), ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, s, a, m, unnest(range(1, len(s) - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < len(s))
  GROUP BY ALL),
whole AS (
  SELECT best.* FROM best LEFT JOIN around ON best.lang = around.lang AND best.phrase = around.phrase
  WHERE coalesce(100::HUGEINT * around.a < 80::HUGEINT * best.a, true)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM whole)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score FROM ranked JOIN n ON ranked.lang = n.lang WHERE rank <= 2000"""

_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"

MANIFEST_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
d AS (
  SELECT *, coalesce('s' || source, '') AS tree, {_LEAF.format(text="text")} AS h, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS even
  FROM documents, crc),
e AS (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
leaf AS (
  SELECT doc_id, tree, h, {_LEAF.format(text="changed")} AS other,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM e),
lv(tree, l, pos, h, n) AS (
  SELECT tree, 0, pos, h, n FROM leaf
  UNION ALL
  SELECT tree, l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM lv WHERE n > 1
  GROUP BY tree, l, pos // 3),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tv(l, pos, h, n) AS (
  SELECT 0, pos, h, n FROM sub
  UNION ALL
  SELECT l + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tv WHERE n > 1
  GROUP BY l, pos // 3),
node AS (SELECT * FROM lv WHERE n > 1 UNION ALL SELECT 't', * FROM tv WHERE n > 1),
side AS (
  SELECT a.tree, a.l, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lh,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rh, any_value((a.n + 2) // 3) AS n
  FROM node a JOIN node b ON a.tree = b.tree AND a.l = b.l AND a.pos // 3 = b.pos // 3 GROUP BY a.tree, a.l, a.pos),
up AS (
  SELECT side.*, CASE WHEN side.n = 1 AND side.tree <> 't' THEN 't' ELSE side.tree END AS t2,
    CASE WHEN side.n = 1 AND side.tree <> 't' THEN 0 ELSE l + 1 END AS l2,
    CASE WHEN side.n = 1 AND side.tree <> 't' THEN sub.pos ELSE side.pos // 3 END AS p2
  FROM side LEFT JOIN sub ON side.tree = sub.tree),
climb(doc_id, leaf, own, tree, l, pos, proof, f) AS (
  SELECT doc_id, leaf.h, leaf.tree, CASE WHEN leaf.n = 1 THEN 't' ELSE leaf.tree END, 0, CASE WHEN leaf.n = 1 THEN sub.pos ELSE leaf.pos END,
    '', other
  FROM leaf JOIN sub ON leaf.tree = sub.tree
  UNION ALL
  SELECT doc_id, leaf, own, t2, l2, p2, proof || lh || rh, sha256(lh || f || rh)
  FROM climb JOIN up ON climb.tree = up.tree AND climb.l = up.l AND climb.pos = up.pos),
root AS (SELECT h, l FROM tv WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified
FROM climb JOIN root ON climb.tree = 't' AND climb.l = root.l JOIN sub ON climb.own = sub.tree"""

QUERIES = {
    "op1_bpe": (bpe_query, None), "op2_toxicity": (toxicity_query, None), "op3_packing": (packing_query, None),
    "op4_neardup": (neardup_query, NEARDUP_SQL), "op5_quality": (quality_query, None), "op6_pii": (pii_query, None),
    "op7_substring": (substring_query, SUBSTRING_SQL), "op8_fingerprint": (merkle_query, None),
    "op9_chat": (chat_query, CHAT_SQL), "op10_neighbours": (hnsw_query, None),
    "op11_warc": (warc_query, WARC_SQL), "op13_collocations": (collocations_query, COLLOCATION_SQL),
    "op12_manifest": (manifest_query, MANIFEST_SQL),
}
