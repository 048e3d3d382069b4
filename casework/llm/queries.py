"""The dealt operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, chat, fingerprints, hpylm, jaccard, lines, mixing, pieces, pii, quality, ranked, sharding, webtext
from .scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = quality.with_features(docs).withColumn("votes", quality.votes(F.col("features")))
    df = stored(df.drop("text"), "quality")
    model = quality.fit(df)
    f, good = F.col("features"), model.posterior(F.col("votes"))
    return df.select(
        "doc_id", "features.n_words", "features.word_chars", "features.n_symbols", "features.n_dup_lines", "features.n_repeat_words",
        quality.base_failed(f).alias("base_failed"),
        (~quality.base_failed(f) & (good >= 0.5)).alias("kept"),
        good.alias("good_probability"),
    )


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.drop_common_lines(docs, least_docs=10)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op8_line_dedup"] = r"""
WITH l AS (SELECT doc_id, t.i, t.line, lower_key.k FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1), lambda i: {'i': i, 'line': string_split(coalesce(text, ''), chr(10))[i]})) AS t FROM documents),
    LATERAL (SELECT translate(regexp_replace(t.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k) lower_key),
common AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN common c ON l.k = c.k GROUP BY doc_id
"""


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM e GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS full_size FROM s),
l AS (SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () - coalesce(sum(full_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl FROM w
    WINDOW o AS (ORDER BY full_size / weight, source NULLS LAST), b AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(full_size, coalesce(weight * (SELECT arg_min(x.lvl, x.pos) FROM l x WHERE x.lvl * x.weight <= x.full_size), full_size)) AS target FROM l),
c AS (SELECT e.source, class, sum(size) AS class_size, (class + 1)::DOUBLE * sum(size) AS mass FROM e GROUP BY e.source, class),
f AS (SELECT c.*, t.source_size, t.target, CASE WHEN sum(mass) OVER p - coalesce(sum(mass) OVER b, 0) > 0 THEN
    (target - 3 * CAST(coalesce(sum(class_size) OVER b, 0) AS DOUBLE)) / (sum(mass) OVER p - coalesce(sum(mass) OVER b, 0)) END AS factor
    FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
    WINDOW p AS (PARTITION BY c.source), b AS (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN class_size > 0 THEN greatest(least(3.0::DOUBLE, coalesce(arg_max(factor, CASE WHEN factor * (class + 1) <= 3 THEN class END) OVER (PARTITION BY source) * (class + 1), 3.0)), 0.0) ELSE 0.0 END AS copies FROM f),
h AS (SELECT *, floor(copies) AS certain, copies - floor(copies) AS p, target - sum(floor(copies) * class_size) OVER (PARTITION BY source) AS rest FROM g),
r AS (SELECT e.doc_id, e.size, e.source, h.source_size, h.target, certain, p, rest, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + p * (1 - u)) END AS rank
    FROM e JOIN h ON e.source IS NOT DISTINCT FROM h.source AND e.class = h.class),
k AS (SELECT *, p > 0 AS part, sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin FROM r),
m AS (SELECT *, max(fin - size / 2) OVER (PARTITION BY source, part ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS far FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST((certain + CASE WHEN part AND far <= rest AND rest > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM m
"""


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(docs))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


@query
def op3_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("conversation").alias("conv_id"), "speaker", "part", "n_turns", "n_learned", "rendered", mask.alias("mask"))


ORACLES["op3_chat_perspectives"] = r"""
WITH t AS (SELECT conv_id, coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS part, turn, role, text, replace(coalesce(text, ''), '<|', '<\|') || '<|im_end|>' AS rest FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM conversations WHERE role IS NOT NULL),
r AS (SELECT t.*, speaker, role IS NOT DISTINCT FROM speaker AS own, CASE WHEN role IS NOT DISTINCT FROM speaker THEN '<|im_start|>assistant' || chr(10)
    ELSE '<|im_start|>user name=' || replace(coalesce(role, 'unknown'), '<|', '<\|') || chr(10) END AS head FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, sum(length(head) + length(rest) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS UNBOUNDED PRECEDING) AS fin FROM r)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_learned,
    string_agg(head || rest || chr(10), '' ORDER BY fin) AS rendered,
    coalesce(string_agg(CAST(fin - 1 - length(rest) AS VARCHAR) || '-' || CAST(fin - 1 AS VARCHAR), ',' ORDER BY fin) FILTER (WHERE own), '') AS mask
FROM s GROUP BY conv_id, speaker, part
"""


@query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymised(docs, key="documents")
    return out.select("doc_id", "text", F.size("__replaced").cast("long").alias("n_replaced"), F.col("__replaced").alias("replaced"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.documents_with_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    orders = list(permutations("ABCDE"))
    return audit.audit(rows, "ABCDE", orders, mask="mask", part="part", measures={"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


ORACLES["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
y AS (SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN y ON m.doc_id = y.doc_id GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (SELECT a.name || b.name || x.name || d.name || e.name AS filter_order, [a.bit, b.bit, x.bit, d.bit, e.bit] AS bits
    FROM f a, f b, f x, f d, f e WHERE a.bit + b.bit + x.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, x.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(step)),
p AS (SELECT part, filter_order, CAST(step AS INT) AS step, bit,
    CAST(sum(n) FILTER (WHERE mask & (before | bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (WHERE mask = bit) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
    coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM p
"""


@query
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return webtext.extract(pages, webtext.fit(webtext.labelled(pages)))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


ORACLES["op11_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, CAST(75 + (25 * len(w) * docs) // total AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
q AS (SELECT q, item_id, term, count(*) AS n FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY q, item_id, term),
c AS (SELECT q, item_id, r, doc_id, CAST(sum(n * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
