"""Linkage frames derived from the test tables, in DataFrame form and as DuckDB SQL.

The tables hold no business records, so these are made of documents: a name, an
address and a country from a text's first sentence, some of its words and its
length. They are fixtures for the linkage queries, not a reading of the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.text import basic_clean
from ..operators import blocking, matching
from ..functions import similarity as S

LEGAL, STATES = ("", "llc", "ltd", "pvt ltd"), ("", "tx", "ny")
COUNTRY = {"en": "US", "es": "India", "fr": "France", "de": "Germany"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw business records made of documents: a third is the entity side, the rest the pool."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    source = 1 + F.col("doc_id") % 3
    w = F.split("text", " ")
    word = lambda i: F.concat(F.lit("q"), F.lower(F.regexp_replace(F.coalesce(F.get(w, i), F.lit("")), "[^A-Za-z]", "")))
    country = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in COUNTRY.items()], F.lit(""))
    return d.select(
        F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("entity_id"),
        source.cast("int").alias("source"),
        F.trim(F.substring(F.regexp_extract("text", "^[^.\\n]*", 0), 1, 60)).alias("business_name"),
        F.concat((1 + F.col("n_chars") % 900).cast("string"), F.lit(" "), word(F.lit(20)), F.lit(" Street, "), word(F.lit(21)), F.lit(", "), (10000 + (F.col("n_chars") * 7919) % 90000).cast("string")).alias("business_address"),
        country.alias("country"),
        F.lower(F.substring("text", 1, 80)).alias("head"),
        "n_chars",
    )


def norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in normalised columns, with plain rules that SQL can follow; `normalise` has the full ones."""
    r = records(spark, sf_dir)
    part = lambda i: F.regexp_extract("business_address", "^([0-9]+) (q[a-z]*) Street, (q[a-z]*), ([0-9]+)$", i)
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("n_chars") % len(x) + 1).cast("int"))
    return r.select(
        "entity_id", "source", F.lower("country").alias("country_norm"), F.array_join(basic_clean(F.col("business_name")), " ").alias("name_norm"), pick(*LEGAL).alias("name_legal"),
        F.concat_ws(" ", part(1), part(2), part(3), part(4)).alias("address_core"), F.concat_ws(" ", part(1), part(2), part(3), part(4)).alias("address_norm"),
        part(1).alias("addr_house"), part(4).alias("addr_postal"), pick(*STATES).alias("addr_state"), part(3).alias("addr_city"), F.concat_ws(" ", part(2), part(3)).alias("addr_tail2"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("bank "), part(2))).otherwise("").alias("landmark_tokens"), "head",
    )


def entities(n: DataFrame) -> DataFrame:
    return n.where("source = 1").select(F.col("entity_id").alias("s1_id"), "country_norm", "head", "name_norm")


def pool(n: DataFrame) -> DataFrame:
    return n.where("source > 1").select(F.col("entity_id").alias("pool_id"), "head", "name_norm")


def truth(n: DataFrame) -> DataFrame:
    """Pairs with the same first 80 characters."""
    return entities(n).select("s1_id", "head").join(pool(n).select("pool_id", "head"), "head").select("s1_id", "pool_id").distinct()


def candidates(n: DataFrame) -> DataFrame:
    return blocking.candidates(n)


def claims(n: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Candidates with a plain score: token overlap of the names, and evidence."""
    pairs = candidates(n) if pairs is None else pairs
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= 2))
    p = pairs.join(entities(n).select("s1_id", tokens("name_norm").alias("a")), "s1_id").join(pool(n).select("pool_id", tokens("name_norm").alias("b")), "pool_id")
    return p.select("s1_id", "pool_id", F.round(0.5 * S.jaccard(F.col("a"), F.col("b")) + 0.01 * F.least("evidence", F.lit(50)), 6).alias("score"))


# The same in DuckDB SQL.


def _fold_sql(x: str) -> str:
    low = f"lower(replace(replace(replace(translate({x}, '{V.LATIN_FROM}', '{V.LATIN_TO}'), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))"
    for v in "aeiou":
        low = f"replace({low}, '{v}{v}', '{v}')"
    for c in "bcdfghjklmnpqrstvwxz":
        low = f"regexp_replace({low}, '{c}{c}+', '{c}', 'g')"
    return f"CASE WHEN strlen({x}) = length({x}) THEN {x} ELSE {low} END"


def clean_sql(x: str) -> str:
    """Tokens of basic_clean, for texts that are no domain."""
    return f"list_filter(regexp_split_to_array(replace(replace(replace(lower({_fold_sql(x)}), '&', ' and '), '+', ' and '), '.', ''), '[^0-9a-z]+'), lambda t: t <> '')"


_W = "'q' || lower(regexp_replace(coalesce(string_split(text, ' ')[{}], ''), '[^A-Za-z]', '', 'g'))"
RECORDS = f"""rec AS (SELECT 'S' || (1 + doc_id % 3) || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS entity_id, CAST(1 + doc_id % 3 AS INTEGER) AS source,
 trim(left(regexp_extract(text, '^[^.\\n]*'), 60)) AS business_name,
 CAST(1 + n_chars % 900 AS VARCHAR) || ' ' || {_W.format(21)} || ' Street, ' || {_W.format(22)} || ', ' || CAST(10000 + (n_chars * 7919) % 90000 AS VARCHAR) AS business_address,
 CASE lang WHEN 'en' THEN 'US' WHEN 'es' THEN 'India' WHEN 'fr' THEN 'France' WHEN 'de' THEN 'Germany' ELSE '' END AS country, lower(left(text, 80)) AS head, n_chars,
 CAST(1 + n_chars % 900 AS VARCHAR) AS house, {_W.format(21)} AS q1, {_W.format(22)} AS q2, CAST(10000 + (n_chars * 7919) % 90000 AS VARCHAR) AS postal
 FROM documents WHERE text IS NOT NULL)"""
NORM = f"""{RECORDS}, norm AS (SELECT entity_id, source, lower(country) AS country_norm, array_to_string({clean_sql('business_name')}, ' ') AS name_norm,
 concat_ws(' ', house, q1, q2, postal) AS address_core, house AS addr_house, postal AS addr_postal, q2 AS addr_city, concat_ws(' ', q1, q2) AS addr_tail2, head,
 {list(LEGAL)}[n_chars % {len(LEGAL)} + 1] AS name_legal, {list(STATES)}[n_chars % {len(STATES)} + 1] AS addr_state, CASE WHEN n_chars % 2 = 0 THEN 'bank ' || q1 ELSE '' END AS landmark_tokens FROM rec)"""
_STOP = ", ".join(f"'{w}'" for w in V.NAME_STOPWORDS)
POSTINGS = f"""{NORM}, tok AS (SELECT *, list_filter(string_split(name_norm, ' '), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t))[1:4] AS ct,
 list_transform(list_sort(list_transform(list_filter(string_split(address_core, ' '), lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '[0-9]+')), lambda t, i: {{'l': -length(t), 'i': i, 't': t}})), lambda x: x.t)[1:3] AS adr FROM norm WHERE name_norm <> '' OR address_core <> ''),
post AS (SELECT strategy, key, entity_id, source FROM (
 SELECT 'name_token' AS strategy, 'nt|' || unnest(ct) AS key, entity_id, source FROM tok
 UNION ALL SELECT 'name_sorted', 'ns|' || array_to_string(list_sort(ct), '|'), entity_id, source FROM tok WHERE len(ct) BETWEEN 2 AND 4
 UNION ALL SELECT 'addr_postal', 'pc|' || addr_postal, entity_id, source FROM tok WHERE addr_postal <> ''
 UNION ALL SELECT 'addr_token', 'at|' || unnest(adr), entity_id, source FROM tok
 UNION ALL SELECT 'addr_house', 'hs|' || addr_house || '|' || adr[1], entity_id, source FROM tok WHERE addr_house <> '' AND len(adr) > 0
 UNION ALL SELECT 'addr_tail', 'tl|' || addr_tail2, entity_id, source FROM tok WHERE addr_tail2 <> ''
 UNION ALL SELECT 'country_name', 'cn|' || country_norm || '|' || list_sort(list_transform(ct, lambda t, i: {{'l': -length(t), 'i': i, 't': t}}))[1].t, entity_id, source FROM tok WHERE country_norm <> '' AND len(ct) > 0
) WHERE length(key) <= 63)"""
EVIDENCE = f"""{POSTINGS}, blocks AS (SELECT strategy, key, count(*) AS n FROM post WHERE source > 1 GROUP BY ALL HAVING count(*) <= 500),
ev AS (SELECT a.entity_id AS s1_id, b.entity_id AS pool_id, CAST(count(*) AS INTEGER) AS evidence FROM post a JOIN post b ON a.strategy = b.strategy AND a.key = b.key JOIN blocks k ON k.strategy = b.strategy AND k.key = b.key
 WHERE a.source = 1 AND b.source > 1 GROUP BY ALL)"""
CANDIDATES = f"""{EVIDENCE}, cand AS (SELECT s1_id, pool_id, least(evidence, 255) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY evidence DESC, pool_id) AS r FROM ev) WHERE r <= 200),
ent AS (SELECT entity_id AS s1_id, country_norm, head, name_norm FROM norm WHERE source = 1), pl AS (SELECT entity_id AS pool_id, head, name_norm FROM norm WHERE source > 1),
truth AS (SELECT DISTINCT s1_id, pool_id FROM ent JOIN pl USING (head))"""
_SET = "list_distinct(list_filter(string_split({}, ' '), lambda t: length(t) >= 2))"
JACCARD = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"
CLAIMS = f"""{CANDIDATES}, cs AS (SELECT c.*, {_SET.format('e.name_norm')} AS a, {_SET.format('p.name_norm')} AS b FROM cand c JOIN ent e ON c.s1_id = e.s1_id JOIN pl p ON c.pool_id = p.pool_id),
claims AS (SELECT s1_id, pool_id, round(0.5 * {JACCARD.format(a='a', b='b')} + 0.01 * least(evidence, 50), 6) AS score FROM cs)"""
OWNED = f"""{CLAIMS}, owned AS (SELECT s1_id, pool_id, score FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC, s1_id) AS r FROM claims WHERE score >= 0.3) WHERE r = 1)"""
F05 = "CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0 WHEN n_true = 0 OR n_pred = 0 OR n_hit = 0 THEN 0.0 ELSE 1.25 * (n_hit / n_pred) * (n_hit / n_true) / (0.25 * (n_hit / n_pred) + n_hit / n_true) END"
SCORES = f"""{OWNED}, counts AS (SELECT s1_id, count(t.pool_id) AS n_true, count(o.pool_id) AS n_pred, count(CASE WHEN t.pool_id IS NOT NULL AND o.pool_id IS NOT NULL THEN 1 END) AS n_hit
 FROM (SELECT s1_id, pool_id FROM truth UNION SELECT s1_id, pool_id FROM owned) u LEFT JOIN truth t USING (s1_id, pool_id) LEFT JOIN owned o USING (s1_id, pool_id) GROUP BY s1_id),
filled AS (SELECT e.s1_id, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_hit, 0) AS n_hit FROM ent e LEFT JOIN counts USING (s1_id)),
scores AS (SELECT *, {F05} AS f05 FROM filled)"""
