"""Registered queries of the corpus operators and their oracle SQL.

``QUERIES[name](spark, sf_dir)`` runs an operator with production parameters
over its whole table; ``ORACLE[name]`` is DuckDB SQL of the same rows where
SQL can express them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import audit_documents
from .common import table
from .fingerprint import fingerprint_documents
from .lines import drop_repeated_lines
from .mixing import mix_sources
from .pieces import decoder, encode_documents
from .pii import replace_private
from .quality import score_quality
from .repair import damaged, repair_conversations
from .sharding import shard_documents
from .similar import similar_documents
from .substrings import remove_repeats
from .toxicity import score_toxicity
from .vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_sharding")
def op1_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=40)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS want,
         sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, sid ROWS UNBOUNDED PRECEDING) AS rest,
         CAST(sum(cap) OVER (ORDER BY cap / w, sid ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS capsum FROM s2),
s4 AS (SELECT *, capsum + CAST(cap AS DOUBLE) * rest / w <= want AS capped FROM s3),
s5 AS (SELECT *, CAST(coalesce(sum(cap) FILTER (capped) OVER (), 0) AS DOUBLE) AS given, sum(w) FILTER (NOT capped) OVER () AS free_w FROM s4),
s6 AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE w * (want - given) / free_w END AS target FROM s5),
b0 AS (SELECT sum(source_size) * 1.5::DOUBLE AS all_words, greatest(1, CAST(ceil(sum(source_size) * 1.5::DOUBLE / 65536) AS BIGINT)) AS block FROM s0),
b AS (SELECT block, CAST(ceil(all_words / block) AS BIGINT) AS slots FROM b0),
u AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid,
        coalesce(sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS hi, sum(target) OVER () AS total FROM s6),
iv AS (SELECT sid, (hi - target) / total AS lo, CASE WHEN sid = max(sid) FILTER (target > 0) OVER () THEN 2.0::DOUBLE ELSE hi / total END AS hi FROM u WHERE target > 0),
pt AS (SELECT i, i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE) AS p FROM b, range(65536) r(i) WHERE i < slots),
hit AS (SELECT sid, i AS slot, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS rank FROM pt JOIN iv ON p >= lo AND p < hi),
sl AS (SELECT sid, rank, slot FROM hit UNION ALL SELECT sid, 0, sid + slots FROM iv, b WHERE sid NOT IN (SELECT sid FROM hit)),
n AS (SELECT sid, count(*) AS n, max(slot) >= any_value(slots) AS small FROM sl, b GROUP BY sid),
g AS (SELECT u.sid, source, source_size, target, CASE WHEN small THEN greatest(1, CAST(floor(target + 0.5) AS BIGINT)) ELSE block END AS step,
        least(CASE WHEN small THEN CAST(floor(target + 0.5) AS BIGINT) ELSE coalesce(n, 0) * block END, 2 * source_size) AS words
      FROM u CROSS JOIN b LEFT JOIN n ON n.sid = u.sid),
l AS (SELECT d.doc_id, d.size, g.*, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY
          md5('17|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || md5(coalesce(d.text, ''))), d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS lo
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(lo + size, words) - lo) + greatest(0, least(lo + size + source_size, words) - lo - source_size) AS BIGINT) AS taken,
  CAST(coalesce(slot, -1) AS BIGINT) AS first_slot
FROM l LEFT JOIN sl ON sl.sid = l.sid AND sl.rank = lo // step AND size > 0 AND lo < words"""


@register("op6_mixing", OP6_SQL)
def op6_mixing(spark, sf_dir):
    """The mix; first_slot is -1 for documents that no slot draws."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"))


@register("op2_quality")
def op2_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_fingerprints")
def op4_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY array_to_string(w[s:s+12], ' ')) AS m FROM win),
hit AS (SELECT doc_id, list(s) AS ss FROM (SELECT DISTINCT doc_id, s FROM g WHERE m < doc_id) GROUP BY doc_id),
cov AS (SELECT doc_id, list_distinct(flatten(list_transform(ss, lambda x: range(x, x + 13)))) AS gone FROM hit),
k AS (SELECT d.doc_id, d.w, coalesce(cov.gone, []) AS gone FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM k"""


@register("op10_substrings", OP10_SQL)
def op10_substrings(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op5_ngram_join")
def op5_ngram_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id JOIN c ON c.x = vec_id"""


@register("op9_vectors", OP9_SQL)
def op9_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@register("op8_pii")
def op8_pii(spark, sf_dir):
    return replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op3_pieces")
def op3_pieces(spark, sf_dir):
    """Ids of every text, and a digest of the text decoded from them."""
    out = encode_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(decoder()("ids"), 256).alias("decoded_sha256"))


OP11_SQL = r"""
WITH d0 AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
d1 AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e FROM d0),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
        100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, e,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d1 LEFT JOIN l ON l.doc_id = d1.doc_id),
cl AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order FROM f v, f w, f x, f y, f z
      WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
r AS (SELECT cl.*, filter_order, least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
        CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
        CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS goes FROM cl, o),
s AS (SELECT r.*, step, substr(filter_order, step, 1) AS filter FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT *, CASE filter WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
        a::INT + b::INT + c::INT + d::INT + e::INT AS n_fails FROM s),
t AS (SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (goes > step), 0) AS kept, coalesce(sum(n) FILTER (goes = step), 0) AS removed,
        coalesce(sum(n) FILTER (fails AND goes < step), 0) AS redundant, coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (goes = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (goes = step), 0) AS toxic_lost
      FROM g GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM t"""


@register("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark, sf_dir):
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT rid, doc_id, key FROM k WHERE length(key) >= 40)
      GROUP BY key HAVING count(*) >= 5),
m AS (SELECT rid, k.doc_id, i, line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid"""


@register("op12_line_dedup", OP12_SQL)
def op12_line_dedup(spark, sf_dir):
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


# options of one more row in front of the rows from i on: x is the state, n the state that a kept row leads to
_OP13_WAYS = """list_sort(list_filter([
    {{'c': f[{x}].c + 2, 'a': 'D' || f[{x}].a, 'p': f[{x}].p}},
    CASE WHEN fault NOT IN (1, 2) AND {keeps} THEN {{'c': f[{n}].c + stay, 'a': 'K' || f[{n}].a, 'p': role || ':' || text || coalesce(chr(10) || f[{n}].p, '')}} END,
    CASE WHEN fault NOT IN (1, 2) THEN {{'c': f[{r}].c + stay + 1, 'a': 'R' || f[{r}].a, 'p': '{name}:' || text || coalesce(chr(10) || f[{r}].p, '')}} END],
    lambda w: w IS NOT NULL))[1]"""
_OP13_PUT = "{{'c': {x}.c + 5, 'a': 'I' || {x}.a, 'p': '{name}:' || coalesce(chr(10) || {x}.p, '')}}"
_U, _A = "user", "assistant"
OP13_SQL = r"""
WITH RECURSIVE q AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS ch FROM conversations),
b AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(ch,
    lambda x: list_transform(range(8), lambda j: (ord(x)::BIGINT >> j) & 1)))),
    lambda v, k: xor(v >> 1, CASE WHEN xor(v, k) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) % 20 AS hit FROM q),
w AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS dup FROM w),
t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN dup THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    left(role, 1) AS r, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before FROM o),
s AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY conv_id),
z AS (SELECT conv_id, n AS i, [{'c': 0, 'a': '', 'p': NULL::VARCHAR}, {'c': 10, 'a': 'II', 'p': 'user:' || chr(10) || 'assistant:'},
    {'c': 5, 'a': 'I', 'p': 'assistant:'}, {'c': 0, 'a': '', 'p': NULL::VARCHAR}] AS f FROM s
  UNION ALL
  SELECT conv_id, i - 1, [list_sort([g0, """ + _OP13_PUT.format(x="h2", name=_U) + """])[1], list_sort([g1, """ + _OP13_PUT.format(x="h2", name=_U) + """])[1], h2, h3]
  FROM (SELECT *, list_sort([g2, """ + _OP13_PUT.format(x="g3", name=_A) + """])[1] AS h2, list_sort([g3, """ + _OP13_PUT.format(x="g2", name=_U) + r"""])[1] AS h3
    FROM (SELECT conv_id, i, """ + ", ".join(f"{_OP13_WAYS.format(x=x, n=n, r=r, keeps=k, name=m)} AS g{x - 1}" for x, n, r, k, m in (
        (1, "CASE r WHEN 's' THEN 2 ELSE 3 END", 3, "r IN ('s', 'u')", _U), (2, 3, 3, "r = 'u'", _U), (3, 4, 4, "r = 'a'", _A), (4, 3, 3, "r = 'u'", _U))) + r"""
      FROM (SELECT z.conv_id, z.i, z.f, t.role, t.text, t.r, t.fault, CASE WHEN t.fault = 3 THEN 5 ELSE 0 END AS stay
            FROM z JOIN t ON z.conv_id IS NOT DISTINCT FROM t.conv_id AND z.i = t.i)))),
e AS (SELECT conv_id, f[1] AS f FROM z WHERE i = 0)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.f.c, 0) AS BIGINT) AS cost,
  coalesce(e.f.a, '') AS audit, sha256(coalesce(e.f.p, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""


@register("op13_repair", OP13_SQL)
def op13_repair(spark, sf_dir):
    return repair_conversations(damaged(table(spark, sf_dir, "conversations"))).report
