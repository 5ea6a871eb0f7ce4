"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic_ann, bpe, brown_lm, centroid_clustering, conversation_repair, feistel_shards, jaccard_join, kn_quality, license_scan, quality_rules, source_mix, toxicity, url_filter
from .shared import table

#: The rules that op8 judges by: host, path, verdict.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.brown_scores(table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 7))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents")).drop("spans")


def op4_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op5_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.kn_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85).drop("key")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rejected_by")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op12_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.centroid_clusters(table(spark, sf_dir, "embeddings"))[0].withColumnRenamed("id", "vec_id")


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    light = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = feistel_shards.sharded(light)
    return out.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_brown_lm, op2_toxicity, op3_license_scan, op4_anisotropic_ann, op5_kn_quality, op6_jaccard_join, op7_bpe, op8_url_filter, op9_source_mix, op10_quality_rules, op11_conversation_repair, op12_hamerly_clusters, op13_feistel_shards)}

_OP8 = """
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), j AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""

_OP9 = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) >> 2 AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS lim FROM sized GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s
), v AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), f AS (
  SELECT first(level ORDER BY lim / weight, source NULLS LAST) AS final FROM v WHERE lim / weight > level
), t AS (
  SELECT source, source_size, CASE WHEN lim / weight <= level THEN lim ELSE weight * final END AS target FROM v LEFT JOIN f ON true
), b AS (
  SELECT source, copy, greatest(0.0::DOUBLE, least(target - source_size::DOUBLE * copy, source_size::DOUBLE)) AS budget FROM t, (VALUES (0), (1)) AS c(copy)
), r AS (
  SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS n FROM sized GROUP BY source, h
), e AS (
  SELECT b.source, copy, max(h) FILTER (upto - n <= budget AND (upto <= budget OR upto - budget <= budget - (upto - n))) AS h
  FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source GROUP BY b.source, copy
), c AS (
  SELECT sized.doc_id, size, sized.source, sized.h, count(e.h) AS copies
  FROM sized LEFT JOIN e ON sized.source IS NOT DISTINCT FROM e.source AND sized.h <= e.h GROUP BY ALL
)
SELECT c.doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
"""

_OP6 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN []::VARCHAR[] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
    ELSE list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id, doc_id AS b FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.b
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""

#: crc32 of a text's UTF-8 bytes, by a table that follows from the polynomial's rule.
_CRC = """
RECURSIVE rule(b, c, k) AS (
  SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rule WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM rule WHERE k = 8
)
"""


def _crc(text: str) -> str:
    """SQL for the crc32 of a column that isn't null, beside a row of crc_table."""
    digits = f"list_transform(string_split(lower(hex(encode({text}))), ''), lambda d: CAST(strpos('0123456789abcdef', d) - 1 AS BIGINT))"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(list_zip(list_filter({digits}, lambda d, i: i % 2 = 1), list_filter({digits}, lambda d, i: i % 2 = 0)), lambda p: p[1] * 16 + p[2])), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8))) END"


def _feistel_sql(n: str, shards: int, seed: int) -> str:
    """CTEs from numbered(number, ...) to placed(number, place): the network's rounds, again for numbers that are outside."""
    word = "CAST(4294967295 AS UBIGINT)"
    mixed = "CAST(right_ AS UBIGINT)"
    first = f"(({mixed} * {feistel_shards.MIX[0]} + key) & {word})"
    second = f"((xor({first}, {first} >> 15) * {feistel_shards.MIX[1]}) & {word})"
    keys = feistel_shards.keys_of(seed)
    return f"""
), size AS (
  SELECT {n} AS n, greatest(1, CAST(ceil(greatest(1, len(ltrim(bin({n} - 1), '0'))) / 2.0) AS INTEGER)) AS h FROM numbered
), walk(number, left_, right_, step, place) AS (
  SELECT number, CAST(number >> h AS UBIGINT), CAST(number & ((1 << h) - 1) AS UBIGINT), 0, CAST(NULL AS UBIGINT) FROM numbered, size
  UNION ALL
  SELECT number, CASE WHEN step < {len(keys)} THEN right_ ELSE left_ END,
    CASE WHEN step < {len(keys)} THEN xor(left_, xor({second}, {second} >> 13) & CAST((1 << h) - 1 AS UBIGINT)) ELSE right_ END,
    CASE WHEN step < {len(keys)} THEN step + 1 ELSE 0 END,
    CASE WHEN step = {len(keys)} THEN (left_ << h) | right_ END
  FROM (SELECT walk.*, n, h, CAST(coalesce({keys}[step + 1], 0) AS UBIGINT) AS key FROM walk, size WHERE place IS NULL OR place >= n)
), placed AS (
  SELECT number, place FROM walk, size WHERE place < n
)
"""


_OP13 = (
    f"WITH {_CRC}, numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS number FROM ("
    f"SELECT doc_id, CAST(octet_length(encode(own)) + 16 AS BIGINT) AS size, CAST({_crc('own')} AS BIGINT) AS text_crc32 FROM (SELECT doc_id, coalesce(text, '') AS own FROM documents), crc_table)"
    + _feistel_sql("count(*)", 40, 0)
    + "SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 40 AS INTEGER) AS shard, CAST(place // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM numbered JOIN placed USING (number)"
)


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """All distances in every round."""
    out = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS slot, list_transform(embedding, lambda v: CAST(floor(256.0::DOUBLE * v::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS cluster, x AS c FROM kept QUALIFY cluster < %d
)""" % k
    for i in range(rounds + 1):
        out += f""", a{i} AS MATERIALIZED (
  SELECT slot, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT slot, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept, c{i}) GROUP BY slot
)"""
        if i < rounds:
            out += f""", c{i + 1} AS MATERIALIZED (
  SELECT c{i}.cluster, coalesce(new.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT cluster, list(v ORDER BY place) AS c FROM (
      SELECT cluster, place, CAST((sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*) AS BIGINT) AS v
      FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS place FROM a{i} JOIN kept USING (slot)) GROUP BY cluster, place
    ) GROUP BY cluster
  ) new ON new.cluster = c{i}.cluster
)"""
    return out + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (slot) JOIN c{rounds} USING (cluster)
"""


def _with(state: str, cost: str | int, edit: str, line: str) -> str:
    """A state's best way, one edit on: {k: cost in ten digits and audit, r: repaired lines}; null where there is none."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'k': printf('%010d', CAST(left({state}.k, 10) AS BIGINT) + {cost}) || substr({state}.k, 11) || '{edit}', 'r': {state}.r || {line}}} END"


def _least(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _repair_sql() -> str:
    """The lattice row by row, with the best way into each of the four states (s0 nothing yet, s1 after s, s2 after u, s3 after a)."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    none = "CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR))"
    kept = lambda state, initial: f"CASE WHEN NOT forced AND initial = '{initial}' THEN {_with(state, 'worse', 'K', 'line')} END"
    reroled = lambda state, line: f"CASE WHEN NOT forced THEN {_with(state, 'worse + 1', 'R', line + ' || text')} END"
    gone = lambda state: _with(state, 2, "D", "''")
    to_user = [f(x, y) for x in ("s0", "s1", "c3") for f, y in ((kept, "u"), (reroled, user))]
    return f"""
WITH {_CRC}, drawn AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), dealt AS (
  SELECT conv, turn, role, text, {_crc('name')} % 20 AS draw FROM drawn, crc_table
), after AS (
  SELECT conv, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM dealt)
), own AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS core, left(role, 1) AS initial
  FROM after
), seen AS (
  SELECT *, core = '' AS blank, core <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair
  FROM own
), marked AS MATERIALIZED (
  SELECT *, NOT blank AND NOT again AND NOT regexp_matches(core, '[.!?]$') AS open FROM seen
), best(conv, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'k': '0000000000', 'r': ''}}, {none}, {none}, {none} FROM conversations
  UNION ALL
  SELECT conv, i, {gone('s0')}, {_least(gone('s1'), kept('s0', 's'))}, {_least(gone('c2'), *to_user)},
    {_least(gone('c3'), kept('c2', 'a'), reroled('c2', assistant))}
  FROM (SELECT *, {_least('s3', _with('c2', 5, 'I', assistant))} AS c3 FROM (
    SELECT best.conv, marked.i, s0, s1, s3, {_least('s2', *[_with(x, 5, 'I', user) for x in ('s0', 's1', 's3')])} AS c2,
      blank OR again AS forced, initial, chr(10) || role || ':' || text AS line, text, CASE WHEN open THEN 5 ELSE 0 END AS worse
    FROM best JOIN marked ON marked.conv IS NOT DISTINCT FROM best.conv AND marked.i = best.i + 1))
), ended AS (
  SELECT conv, i, {_least('s0', 's3', _with('s2', 5, 'I', assistant), _with('s1', 10, 'II', f"{user} || {assistant}"))} AS w
  FROM best QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1
), told AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
    count(*) FILTER (open) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv
)
SELECT ended.conv AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(left(w.k, 10) AS BIGINT) AS cost, substr(w.k, 11) AS audit, sha256(substr(w.r, 2)) AS repaired_sha256
FROM ended LEFT JOIN told ON told.conv IS NOT DISTINCT FROM ended.conv
"""


ORACLES: dict[str, str] = {"op6_jaccard_join": _OP6, "op8_url_filter": _OP8, "op9_source_mix": _OP9, "op11_conversation_repair": _repair_sql(), "op12_hamerly_clusters": _cluster_sql(), "op13_feistel_shards": _OP13}
