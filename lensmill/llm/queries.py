"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.llm import bottomk, bpe, conversations, langid, mixing, neighbours, scoring, secrets, sharding, simhash, spelling, suffixes, toxicity
from lensmill.llm.common import held_out, read


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), *tokenizer_paths())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), shards=40)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    predicted = langid.identify(docs, langid.fit(langid.sample(docs)))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(toxicity.sample(docs, read(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_tokens", "offending")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.compared_with_next(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(spark, sf_dir, "documents"))


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score(read(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 9) for c in ("base_score", "score")})


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.trie(read(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_mixing, op3_bpe, op4_sharding, op5_langid, op6_toxicity, op7_neighbours, op8_fingerprints, op9_simhash, op10_suffixes, op11_lm, op12_trie, op13_spelling)
    return {f.__name__: f for f in own}


OP2_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS pick
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source),
caps AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS cap,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sums),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
water AS (SELECT level AS water FROM levels WHERE level * weight <= cap ORDER BY cap / weight, place LIMIT 1),
goals AS (
  SELECT source, place, source_size, least(coalesce((SELECT water FROM water) * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM levels),
tape AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.place,
    CAST(sum(d.size) OVER (PARTITION BY g.place ORDER BY d.pick, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size + d.size / 2.0::DOUBLE AS middle
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
taken AS (
  SELECT *, CASE WHEN size = 0 OR source_size = 0 THEN 0
    ELSE greatest(0, least(3, CAST(floor((target - middle) / source_size) AS BIGINT) + 1)) END AS copies FROM tape)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  CASE WHEN copies > 0 THEN round(CASE place % 3
    WHEN 0 THEN 2 * (middle / target) / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * (middle / target), 0)))
    WHEN 1 THEN middle / target
    ELSE 2 * (middle / target) / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2 * (middle / target))) END, 6) END AS position
FROM taken
"""


OP4_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
sized AS (
  SELECT doc_id, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
summed AS (
  SELECT doc_id, size, key, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS BIGINT) AS text_crc32
  FROM sized CROSS JOIN steps),
line AS (
  SELECT *, row_number() OVER (ORDER BY key, doc_id) - 1 AS nth, CAST(sum(size) OVER (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS finish,
    CAST(sum(size) OVER () AS DOUBLE) / 40 AS capacity FROM summed),
cut AS (SELECT *, CAST(least(floor((finish - size / 2.0::DOUBLE) / capacity), 39) AS INT) AS own FROM line),
spans AS (SELECT key, min(own) AS lo, max(own) AS hi, min(finish - size) AS first_byte, max(finish) AS last_byte, any_value(capacity) AS capacity FROM cut GROUP BY key),
moved AS (
  SELECT key, CAST(least(floor((first_byte + last_byte) / 2.0::DOUBLE / capacity), 39) AS INT) AS kept_in
  FROM spans WHERE lo < hi AND last_byte - first_byte <= 0.1::DOUBLE * capacity),
placed AS (SELECT c.*, coalesce(m.kept_in, c.own) AS shard FROM cut c LEFT JOIN moved m ON c.key = m.key)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(nth - min(nth) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM placed
"""

OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (
  SELECT vec_id, x, list_sum(list_transform(x, lambda c: c * c)) AS norm FROM v
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(least, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(least, v.vec_id)) AS kept
FROM v LEFT JOIN degree ON degree.a = v.vec_id LEFT JOIN least_of ON least_of.a = v.vec_id
"""

OP10_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents),
parts AS (SELECT doc_id, h, n_bytes, unnest(range(0, n_bytes - 99, 500)) AS cut_at FROM docs WHERE n_bytes >= 100),
pieces AS (SELECT doc_id, cut_at, substr(h, 2 * cut_at + 1, 1198) AS piece, least(500, n_bytes - 99 - cut_at) AS n FROM parts),
places AS (SELECT doc_id, cut_at, piece, unnest(range(n)) AS i FROM pieces),
hashed AS (SELECT doc_id, cut_at + i AS p, md5_number(substr(piece, 2 * i + 1, 200)) AS w FROM places),
firsts AS (SELECT w, min((doc_id, p)) AS one FROM hashed GROUP BY w),
windows AS (SELECT doc_id, p, (doc_id, p) <> one AS again FROM hashed JOIN firsts USING (w)),
marks AS (SELECT doc_id, p, CASE WHEN p <= max(p) OVER before + 100 THEN 0 ELSE 1 END AS fresh FROM windows WHERE again
  WINDOW before AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marks),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM spans),
kept AS (
  SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (a - since)) || CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_OP1_KINDS = (
    (0, r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"),
    (1, "AKIA[A-Z0-9]+"), (2, "[0-9a-f]+"), (3, "[A-Za-z0-9+/_-]{20,}"),
)
OP1_SQL = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
cut AS ({" UNION ALL ".join(f"SELECT doc_id, source, body, {k} AS kind, regexp_extract_all(body, '{p}') AS found, string_split_regex(body, '{p}') AS pieces, {f"regexp_extract_all(body, '{p}', 2)" if k == 0 else f"regexp_extract_all(body, '{p}')"} AS held FROM docs" for k, p in _OP1_KINDS)}),
spots AS (SELECT doc_id, source, body, kind, found, pieces, held, unnest(range(1, len(found) + 1)) AS i FROM cut),
spans AS (
  SELECT doc_id, source, body, kind, held[i] AS value,
    CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[i]) AS n FROM spots),
base AS (SELECT * FROM spans WHERE (kind = 0 AND length(value) >= 12) OR (kind = 1 AND length(value) >= 18) OR (kind = 2 AND length(value) >= 16)),
bare AS (
  SELECT s.* FROM spans s WHERE kind = 3 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.a < s.a + s.n AND s.a < b.a + b.n)),
candidates AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (SELECT value, count(DISTINCT coalesce('s' || source, '')) <= 2 AND count(DISTINCT (coalesce('s' || source, ''), body)) <= 5 AS live FROM candidates GROUP BY value),
judged AS (SELECT c.doc_id, c.kind, c.a, c.a + c.n AS b, o.live, ['assign', 'access', 'hex', 'bare'][c.kind + 1] || ':' || c.a || ':' || (c.a + c.n) AS label FROM candidates c JOIN owned o ON c.value = o.value WHERE c.kind < 3 OR o.live),
summed AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(label, ',' ORDER BY a, kind) FILTER (kind < 3) AS base_spans, string_agg(label, ',' ORDER BY a, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs d LEFT JOIN summed s ON d.doc_id = s.doc_id
"""

#: CRC-32 of the bytes whose hexadecimal digits are in {0}; tab comes from the table steps.
_CRC_TABLE = "steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
_CRC = """CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(CAST(length({0}) / 2 AS BIGINT)), lambda i: CAST('0x' || substr({0}, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS BIGINT)"""
_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH {_CRC_TABLE},
coded AS (SELECT doc_id, {_LOWERED.format("coalesce(text, '')")} AS body, hex(encode(coalesce(CAST(doc_id AS VARCHAR), ''))) AS h, row_number() OVER () AS row_no FROM documents),
docs AS (SELECT row_no, doc_id, {_CRC.format("h")} % 7 = 2 AS held_out, list_concat(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'), [chr(10) || '>']) AS words FROM coded CROSS JOIN steps),
placed AS (SELECT row_no, held_out, unnest(words) AS w, unnest(list_prepend(chr(10) || '<', words[1:len(words) - 1])) AS u FROM docs),
ones AS (SELECT w, count(*) AS c FROM placed WHERE NOT held_out GROUP BY w),
contexts AS (SELECT u, count(*) AS c FROM placed WHERE NOT held_out GROUP BY u),
twos AS (SELECT u, w, count(*) AS c FROM placed WHERE NOT held_out GROUP BY u, w),
sums AS (
  SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS total, count(*) AS types,
    CASE WHEN count(*) FILTER (c = 1) = 0 THEN 0.5::DOUBLE ELSE least(0.9::DOUBLE, greatest(0.1::DOUBLE, count(*) FILTER (c = 1) / CAST(count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2) AS DOUBLE))) END AS d FROM ones),
looked AS (
  SELECT row_no, total, types, coalesce(o.c, 0) AS n, coalesce(t.c, 0) AS pair_n, coalesce(k.c, 0) AS seen,
    CASE WHEN total = 0 THEN 1 WHEN o.c > 0 THEN (o.c - d) / total ELSE d * types / total END AS p
  FROM placed a CROSS JOIN sums LEFT JOIN ones o ON a.w = o.w LEFT JOIN contexts k ON a.u = k.u LEFT JOIN twos t ON a.u = t.u AND a.w = t.w),
terms AS (
  SELECT row_no, log10((n + 1) / CAST(total + types + 1 AS DOUBLE)) AS base, CASE WHEN pair_n > 0 THEN log10((pair_n + 500.0::DOUBLE * p) / (seen + 500.0::DOUBLE)) ELSE log10(p) END AS taken,
    CASE WHEN pair_n = 0 AND seen > 0 THEN log10(500.0::DOUBLE / (seen + 500.0::DOUBLE)) ELSE 0 END AS failed, n, total FROM looked),
summed AS (
  SELECT row_no, count(*) AS n_tokens, count(*) FILTER (n > 0) AS n_known, any_value(total) AS train_tokens, round(fsum(base), 9) AS base_score FROM terms GROUP BY row_no),
scored AS (SELECT row_no, round(fsum(x), 9) AS score FROM (SELECT row_no, taken AS x FROM terms UNION ALL SELECT row_no, failed AS x FROM terms) both_terms GROUP BY row_no)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM docs JOIN summed USING (row_no) JOIN scored USING (row_no)
"""

OP12_SQL = f"""
WITH {_CRC_TABLE},
told AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT c, md5(length(role) || ':' || role || text) AS turn_key, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM told),
sizes AS (SELECT c, count(*) AS n, hex(encode(CAST(c AS VARCHAR))) AS digits FROM turns GROUP BY c),
named AS (SELECT c, n, {_CRC.format("digits")} % 4 AS h FROM sizes CROSS JOIN steps),
convs AS (SELECT a.c, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM named a LEFT JOIN named b ON b.c = a.c - a.c % 20),
rebuilt AS (
  SELECT v.c, t.pos AS d, t.turn_key, t.words FROM convs v JOIN turns t ON t.c = v.c - v.c % 20 AND t.pos <= v.h
  UNION ALL SELECT v.c, v.k + t.pos - v.h AS d, t.turn_key, t.words FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
paths AS (SELECT c, d, words, md5(string_agg(turn_key, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM rebuilt),
occ AS (SELECT c, d, words, key FROM paths UNION ALL SELECT c, 0 AS d, 0 AS words, '' AS key FROM convs),
linked AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, lead(key) OVER (PARTITION BY c ORDER BY d) IS NULL AS ends FROM occ),
nodes AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(up) AS up, max(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ended FROM linked GROUP BY d, key),
children AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.key = c.key),
under AS (
  SELECT x.d, x.key, count(*) FILTER (y.n_children = 0) AS n_leaves, CAST(sum((y.n_convs - 1) * y.words) AS BIGINT) AS saved_tokens
  FROM whole y JOIN occ x ON x.c = y.conv_id AND x.d <= y.d GROUP BY x.d, x.key)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, u.saved_tokens, sha256(w.ended) AS ends_sha256
FROM whole w JOIN under u ON w.d = u.d AND w.key = u.key LEFT JOIN whole p ON p.d = w.d - 1 AND p.key = w.up
"""

OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
spelled AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
counted AS (SELECT id, run, hex(encode(id || ':' || run)) AS h, count(*) AS n FROM spelled WHERE length(run) >= 7 GROUP BY id, run),
hashed AS (SELECT run, n, {_CRC.format("h")} AS crc FROM counted CROSS JOIN steps),
damaged AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
open_at AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM open_at),
cut AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS m FROM open_at),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.m = w.word
  UNION ALL SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.m = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS nth, count(*) OVER (PARTITION BY word) AS n_near FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND nth = 1),
climbed(word, now) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM climbed c JOIN formed f ON c.now = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.now AS root FROM climbed c JOIN formed f ON c.now = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots r ON f.word = r.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": OP1_SQL, "op2_mixing": OP2_SQL, "op4_sharding": OP4_SQL, "op7_neighbours": OP7_SQL, "op10_suffixes": OP10_SQL, "op11_lm": OP11_SQL, "op12_trie": OP12_SQL, "op13_spelling": OP13_SQL}
