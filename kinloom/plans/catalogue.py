"""Registered queries over the linkage operators, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import similarity as S
from ..functions import text as T
from ..functions import vocab as V
from ..operators import blocking, features, flow, matching, model, profile
from ..operators.normalise import normalise
from ..storage import fresh_path, freed_shuffles, settle
from . import frames as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GRID = [round(0.05 * k, 2) for k in range(1, 20)]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _owned(n: DataFrame) -> DataFrame:
    return matching.resolve(R.claims(n), 0.3)


def _scores(n: DataFrame) -> DataFrame:
    return matching.entity_scores(R.entities(n), R.truth(n), _owned(n))


def _lists(n: DataFrame) -> DataFrame:
    return sources.id_lists(R.entities(n), _owned(n))


# Normalisation


@query(f"WITH {R.RECORDS} SELECT entity_id, source, business_name, business_address, country FROM rec")
def records(spark, sf_dir):
    return R.records(spark, sf_dir).drop("head", "n_chars")


@query(f"WITH {R.RECORDS} SELECT entity_id, lower(country) AS country_norm FROM rec")
def norm_country(spark, sf_dir):
    return R.records(spark, sf_dir).select("entity_id", T.normalise_country(F.concat(F.lit("  "), "country")).alias("country_norm"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS name FROM customer")
def norm_missing(spark, sf_dir):
    c = R.read(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.element_at(F.array(*map(F.lit, (" NULL ", "n/a", "--", "Nil"))), (F.col("c_custkey") / 4 % 4 + 1).cast("int"))).otherwise(F.col("c_name"))
    return c.select("c_custkey", T.clean_missing(raw).alias("name"))


@query(f"WITH {R.RECORDS} SELECT entity_id, array_to_string({R.clean_sql('business_name')}, ' ') AS tokens FROM rec")
def basic_clean(spark, sf_dir):
    return R.records(spark, sf_dir).select("entity_id", F.array_join(T.basic_clean(F.col("business_name")), " ").alias("tokens"))


@query(f"WITH {R.RECORDS} SELECT entity_id, {R._fold_sql('business_name')} AS folded FROM rec")
def translit_collapse(spark, sf_dir):
    return R.records(spark, sf_dir).select("entity_id", T.fold(F.col("business_name")).alias("folded"))


_TLD = ", ".join(f"'{d}'" for d in V.TOP_LEVEL_DOMAINS)
_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(f"SELECT page_id, {_HOST} AS host, list_contains([{_TLD}], string_split({_HOST}, '.')[-1]) AND contains({_HOST}, '.') AS is_domain FROM pages")
def domain_hosts(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return R.read(spark, sf_dir, "pages").select("page_id", host.alias("host"), T.looks_like_domain(host).alias("is_domain"))


@query("SELECT p_partkey, lower(p_name) || ' international services' AS name FROM part")
def name_abbrev_expand(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" Intl. SVCS")).alias("raw"))
    return p.select("p_partkey", F.array_join(T.name_tokens(F.col("raw")), " ").alias("name"))


_SUFFIX = ((" Private Limited", "pvt ltd"), (" Inc.", "inc"), (" of Company", "co"), ("", ""), (" PVT. LTD.", "pvt ltd"), (" LLC", "llc"))


@query("SELECT p_partkey, lower(p_name) AS core, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, (_, v) in enumerate(_SUFFIX)) + " END AS legal FROM part")
def legal_strip(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s, _ in _SUFFIX]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = R.read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", suffix).alias("raw"))
    return T.with_name(p, "raw", "n", scripts=False).select("p_partkey", "n.core", "n.legal")


@query(f"WITH {R.RECORDS} SELECT entity_id, house, CASE WHEN country = 'India' THEN '' ELSE postal END AS postal, house || ' ' || q1 || ' street ' || q2 || ' ' || postal AS norm FROM rec")
def address_postal_house(spark, sf_dir):
    n = normalise(R.records(spark, sf_dir), scripts=False)
    return n.select("entity_id", F.col("addr_house").alias("house"), F.col("addr_postal").alias("postal"), F.col("address_norm").alias("norm"))


@query()
def normalise_records(spark, sf_dir):
    return normalise(R.records(spark, sf_dir))


# Blocking

for _s in blocking.DEFAULT:

    def _keys(spark, sf_dir, s=_s):
        return blocking.postings(R.norm(spark, sf_dir), [s]).select("key", "entity_id")

    QUERIES[f"keys_{_s}"] = _keys
    ORACLE_SQL[f"keys_{_s}"] = f"WITH {R.POSTINGS} SELECT key, entity_id FROM post WHERE strategy = '{_s}'"


@query()
def keys_name_phonetic(spark, sf_dir):
    return blocking.postings(R.norm(spark, sf_dir), ["name_phonetic"]).select("key", "entity_id")


@query(f"WITH {R.POSTINGS} SELECT strategy, key, count(*) AS n FROM post WHERE source > 1 GROUP BY ALL")
def block_sizes(spark, sf_dir):
    return blocking.block_sizes(blocking.postings(R.norm(spark, sf_dir).where("source > 1")))


@query(f"WITH {R.POSTINGS}, k AS (SELECT strategy, key FROM post GROUP BY ALL HAVING count(*) <= 5) SELECT strategy, key, entity_id FROM post JOIN k USING (strategy, key)")
def block_cap_drop(spark, sf_dir):
    return blocking.capped(blocking.postings(R.norm(spark, sf_dir)), 5)


@query(f"WITH {R.EVIDENCE} SELECT s1_id, pool_id, evidence FROM ev")
def candidates_evidence(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return blocking.evidence(blocking.postings(n.where("source = 1")), blocking.postings(n.where("source > 1")))


@query(f"WITH {R.EVIDENCE} SELECT a.strategy, sum(a.n * b.n)::BIGINT AS pairs FROM (SELECT strategy, key, count(*) AS n FROM post WHERE source = 1 GROUP BY ALL) a JOIN blocks b USING (strategy, key) GROUP BY a.strategy")
def query_volume(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return blocking.query_volume(blocking.postings(n.where("source = 1")), blocking.postings(n.where("source > 1")))


@query(f"WITH {R.CANDIDATES} SELECT s1_id, pool_id, evidence FROM cand")
def candidates_topk(spark, sf_dir):
    return R.candidates(R.norm(spark, sf_dir))


@query(f"WITH {R.CANDIDATES} SELECT s1_id AS source1_entity_id, coalesce(string_agg(pool_id, ',' ORDER BY pool_id), '') AS candidate_entity_ids FROM ent LEFT JOIN cand USING (s1_id) GROUP BY s1_id")
def candidates_tsv(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return sources.id_lists(R.entities(n), R.candidates(n), "candidate_entity_ids")


@query(
    f"WITH {R.CANDIDATES}, c AS (SELECT s1_id, count(pool_id) AS n FROM ent LEFT JOIN cand USING (s1_id) GROUP BY s1_id) SELECT count(*) AS entities, count(*) FILTER (n = 0) AS entities_without_candidates, avg(CAST(n = 0 AS DOUBLE)) AS share_without_candidates, sum(n)::BIGINT AS pairs_kept, avg(n) AS mean_candidates, max(n) AS max_candidates, count(*) FILTER (n >= 200) AS cap_fired_entities, 1 - sum(n) / (count(*) * (SELECT count(*) FROM pl)) AS reduction_ratio, (SELECT count(*) FROM ev) AS pairs_before_cap FROM c"
)
def blocking_stats(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    before = blocking.evidence(blocking.postings(n.where("source = 1")), blocking.postings(n.where("source > 1")))
    return blocking.blocking_statistics(R.entities(n), blocking.top_candidates(before), R.pool(n).count(), before_cap=before)


@query(f"""WITH {R.EVIDENCE}, ent AS (SELECT entity_id AS s1_id, head FROM norm WHERE source = 1), pl AS (SELECT entity_id AS pool_id, head FROM norm WHERE source > 1), truth AS (SELECT DISTINCT s1_id, pool_id FROM ent JOIN pl USING (head)),
small AS (SELECT strategy, key FROM post WHERE source > 1 GROUP BY ALL HAVING count(*) <= 20),
both_ev AS (SELECT 500 AS max_block, * FROM ev UNION ALL SELECT 20, a.entity_id, b.entity_id, count(*) FROM post a JOIN post b USING (strategy, key) JOIN small USING (strategy, key) WHERE a.source = 1 AND b.source > 1 GROUP BY 2, 3),
ranked AS (SELECT max_block, s1_id, pool_id, row_number() OVER (PARTITION BY max_block, s1_id ORDER BY evidence DESC, pool_id) AS r FROM both_ev), params AS (SELECT * FROM (VALUES (500), (20)) m(max_block), (VALUES (5), (20)) c(cap)),
hits AS (SELECT p.max_block, p.cap, t.s1_id, count(*) AS n, count(r.r) AS h FROM params p CROSS JOIN truth t LEFT JOIN ranked r ON r.max_block = p.max_block AND r.s1_id = t.s1_id AND r.pool_id = t.pool_id AND r.r <= p.cap GROUP BY ALL),
held AS (SELECT p.max_block, p.cap, e.s1_id, count(r.r) AS n FROM params p CROSS JOIN ent e LEFT JOIN ranked r ON r.max_block = p.max_block AND r.s1_id = e.s1_id AND r.r <= p.cap GROUP BY ALL)
SELECT x.max_block, x.cap, pair_recall, entity_full_recall, mean_candidates FROM (SELECT max_block, cap, sum(h) / sum(n) AS pair_recall, avg(CAST(h = n AS DOUBLE)) AS entity_full_recall FROM hits GROUP BY ALL) x JOIN (SELECT max_block, cap, avg(n) AS mean_candidates FROM held GROUP BY ALL) y USING (max_block, cap)""")
def recall_by_caps(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return blocking.recall_sweep(n, R.truth(n), R.entities(n), caps=(5, 20), max_blocks=(500, 20))


@query()
def recall_leave_one_out(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return blocking.leave_one_out(n, R.truth(n))


@query(f"WITH {R.POSTINGS}, k AS (SELECT strategy, key FROM post GROUP BY ALL HAVING count(*) <= 3) SELECT strategy, key, entity_id FROM post JOIN k USING (strategy, key)")
def reblock_tighter(spark, sf_dir):
    return blocking.reblock(blocking.capped(blocking.postings(R.norm(spark, sf_dir)), 5), 5, 3)


@query(f"WITH {R.CANDIDATES}, l AS (SELECT s1_id, list(pool_id ORDER BY pool_id) AS ids FROM cand GROUP BY 1) SELECT s1_id, array_to_string(ids[1:3], ',') AS ids FROM l")
def candidate_lists_capped(spark, sf_dir):
    ids = R.candidates(R.norm(spark, sf_dir)).groupBy("s1_id").agg(F.array_sort(F.collect_list("pool_id")).alias("ids"))
    twice = ids.select("s1_id", F.concat("ids", "ids").alias("ids"))
    return blocking.capped_lists(twice, 3, "ids").select("s1_id", F.array_join("ids", ",").alias("ids"))


# Context and features


@query(f"WITH {R.CANDIDATES}, d AS (SELECT pool_id, count(*) AS degree FROM cand GROUP BY 1), k AS (SELECT s1_id, count(*) AS candidates FROM cand GROUP BY 1), f AS (SELECT name_norm, count(*) AS frequency FROM pl GROUP BY 1) SELECT s1_id, pool_id, evidence, degree, candidates, frequency FROM cand JOIN d USING (pool_id) JOIN k USING (s1_id) JOIN pl USING (pool_id) JOIN f USING (name_norm)")
def ctx_counts(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return features.with_context(R.candidates(n), n)


_G = "list_distinct(list_transform(range(1, greatest(length(' ' || {0} || ' ') - 1, 2)), lambda i: substring(' ' || {0} || ' ', i, 3)))"


@query(f"WITH {R.CANDIDATES}, s AS (SELECT c.s1_id, c.pool_id, {R._SET.format('e.name_norm')} AS a, {R._SET.format('p.name_norm')} AS b, {_G.format('e.name_norm')} AS x, {_G.format('p.name_norm')} AS y, e.name_norm <> '' AND p.name_norm <> '' AS ok FROM cand c JOIN ent e ON c.s1_id = e.s1_id JOIN pl p ON c.pool_id = p.pool_id) SELECT s1_id, pool_id, CASE WHEN ok THEN {R.JACCARD.format(a='a', b='b')} ELSE 0.0 END AS name_token_jaccard, CASE WHEN ok THEN {R.JACCARD.format(a='x', b='y')} ELSE 0.0 END AS name_char_jaccard FROM s")
def feat_jaccard(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return features.features(R.candidates(n), n, ["us"], columns=["name_token_jaccard", "name_char_jaccard"])


_N = {"name": "a.name_norm <> '' AND b.name_norm <> ''", "addr": "a.address_core <> '' AND b.address_core <> ''"}
_LENGTHS = "CASE WHEN greatest(length(a.{0}), length(b.{0})) > 0 THEN least(length(a.{0}), length(b.{0})) / greatest(length(a.{0}), length(b.{0})) ELSE 0.0 END"
_SAME = "CAST(a.{0} <> '' AND a.{0} = b.{0} AS DOUBLE)"
_WORDS = "list_filter(string_split({0}.{1}, ' '), lambda t: t <> '')"
_PLAIN = {
    "name_len_ratio": _LENGTHS.format("name_norm"),
    "name_token_count_delta": f"CAST(abs(len({_WORDS.format('a', 'name_norm')}) - len({_WORDS.format('b', 'name_norm')})) AS DOUBLE)",
    "name_first_token_match": f"CAST({_WORDS.format('a', 'name_norm')}[1] = {_WORDS.format('b', 'name_norm')}[1] AS DOUBLE)",
    "name_legal_match": _SAME.format("name_legal"),
    "addr_token_jaccard": R.JACCARD.format(a=R._SET.format("a.address_core"), b=R._SET.format("b.address_core")),
    "addr_char_jaccard": R.JACCARD.format(a=_G.format("a.address_core"), b=_G.format("b.address_core")),
    "addr_landmark_jaccard": R.JACCARD.format(a=R._SET.format("a.landmark_tokens"), b=R._SET.format("b.landmark_tokens")),
    "addr_len_ratio": _LENGTHS.format("address_core"),
    **{f"addr_{x}_match": _SAME.format(f"addr_{x}") for x in ("house", "postal", "city", "state", "tail2")},
}
_FLAGS = {
    **{f"{k}_missing_{side}": f"CAST({t}.{c} = '' AS DOUBLE)" for k, c in (("name", "name_norm"), ("addr", "address_core")) for side, t in (("left", "a"), ("right", "b"))},
    "ctx_country_match": _SAME.format("country_norm"),
    "ctx_country_known": "CAST(a.country_norm IN ('us', 'france') AND b.country_norm IN ('us', 'france') AS DOUBLE)",
    "ctx_country_missing": "CAST(a.country_norm = '' OR b.country_norm = '' AS DOUBLE)",
    "ctx_source_b": "CAST(b.source AS DOUBLE)",
    "ctx_candidate_degree": "round(ln(1 + degree), 9)",
    "ctx_source_frequency": "round(ln(1 + frequency), 9)",
    "ctx_entity_candidate_count": "round(ln(1 + candidates), 9)",
    "ctx_shared_block_keys": "CAST(c.evidence AS DOUBLE)",
}
_COUNTS = "d AS (SELECT pool_id, count(*) AS degree FROM cand GROUP BY 1), k AS (SELECT s1_id, count(*) AS candidates FROM cand GROUP BY 1), f AS (SELECT name_norm, count(*) AS frequency FROM norm WHERE source > 1 GROUP BY 1)"


@query(
    f"WITH {R.CANDIDATES}, {_COUNTS} SELECT c.s1_id, c.pool_id, "
    + ", ".join([f"CASE WHEN {_N[x[:4]]} THEN {v} ELSE 0.0 END AS {x}" for x, v in _PLAIN.items()] + [f"{v} AS {x}" for x, v in _FLAGS.items()])
    + " FROM cand c JOIN norm a ON a.entity_id = c.s1_id JOIN norm b ON b.entity_id = c.pool_id JOIN d ON d.pool_id = c.pool_id JOIN k ON k.s1_id = c.s1_id JOIN f ON f.name_norm = b.name_norm"
)
def feat_plain(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    logs = [c for c, v in _FLAGS.items() if v.startswith("round")]
    rows = features.features(R.candidates(n), n, ["us", "france"], columns=[*_PLAIN, *_FLAGS])
    return rows.select("s1_id", "pool_id", *[F.round(c, 9).alias(c) if c in logs else c for c in [*_PLAIN, *_FLAGS]])


@query(
    f"WITH {R.CANDIDATES} SELECT c.s1_id, c.pool_id, round("
    + " + ".join(
        f"{w} * CASE WHEN {ok} THEN {v} ELSE 0.0 END"
        for w, ok, v in (
            (0.5, _N["name"], R.JACCARD.format(a=R._SET.format("a.name_norm"), b=R._SET.format("b.name_norm"))),
            (0.3, _N["name"], R.JACCARD.format(a=_G.format("a.name_norm"), b=_G.format("b.name_norm"))),
            (0.1, _N["addr"], _PLAIN["addr_token_jaccard"]),
            (0.1, "true", _FLAGS["ctx_country_match"]),
        )
    )
    + ", 6) AS score FROM cand c JOIN norm a ON a.entity_id = c.s1_id JOIN norm b ON b.entity_id = c.pool_id"
)
def rule_score(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.rule_score(features.features(R.candidates(n), n, ["us", "france"], columns=list(matching.RULE)))


@query()
def pair_features(spark, sf_dir):
    """Records and candidates are written once; counts, sets and pairs read them."""
    n = settle(R.norm(spark, sf_dir), "norm")
    return features.features(settle(R.candidates(n), "candidates"), n, ["us", "france"])


def _part_pairs(spark, sf_dir):
    p = R.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")


@query("SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 9) AS jaro_winkler FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def feat_jaro_winkler(spark, sf_dir):
    from ..session import ship

    ship(spark)
    return _part_pairs(spark, sf_dir).select("p_partkey", F.round(S.measured(F.col("p_name"), F.col("other"), "jaro_winkler")["jaro_winkler"], 9).alias("jaro_winkler"))


@query()
def feat_string_metrics(spark, sf_dir):
    from ..session import ship

    ship(spark)
    return _part_pairs(spark, sf_dir).select("p_partkey", S.measured(F.col("p_name"), F.col("other"), "indel", "token_sort", "token_set", "partial").alias("m")).select("p_partkey", "m.*")


@query()
def feat_soundex(spark, sf_dir):
    return R.read(spark, sf_dir, "part").select("p_partkey", F.array_join(S.soundexes(F.split(F.lower("p_name"), " ")), " ").alias("codes"))


# Labels, samples, matching, metrics


@query(f"WITH {R.CANDIDATES} SELECT c.s1_id, c.pool_id, c.evidence, CAST(t.s1_id IS NOT NULL AS INTEGER) AS label FROM cand c LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.pool_id = t.pool_id")
def labels(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.label(R.candidates(n), R.truth(n))


@query(f"WITH {R.CANDIDATES}, p AS (SELECT s1_id, count(*) AS n, count(c.pool_id) AS h FROM truth t LEFT JOIN cand c USING (s1_id, pool_id) GROUP BY s1_id) SELECT sum(h) / sum(n) AS pair_recall, avg(CAST(h = n AS DOUBLE)) AS entity_full_recall FROM p")
def recall_ceiling(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.recall(R.truth(n), R.candidates(n))


@query(f"WITH {R.CANDIDATES}, n AS (SELECT country_norm, count(*) AS n FROM ent GROUP BY 1), r AS (SELECT s1_id, country_norm, row_number() OVER (PARTITION BY country_norm ORDER BY md5('7:' || s1_id), s1_id) AS r FROM ent) SELECT s1_id, country_norm, CASE WHEN r <= round_even(n * 0.15, 0) THEN 'validation' ELSE 'train' END AS side FROM r JOIN n USING (country_norm)")
def split_stratified(spark, sf_dir):
    return matching.split(R.entities(R.norm(spark, sf_dir)).select("s1_id", "country_norm"), 0.15, 7)


_QUOTA = """n AS (SELECT country_norm, count(*) AS n FROM ent GROUP BY 1), r AS (SELECT s1_id, country_norm, md5('7:' || s1_id) AS h, row_number() OVER (PARTITION BY country_norm ORDER BY md5('7:' || s1_id), s1_id) AS r FROM ent),
q AS (SELECT s1_id, r.country_norm, h, r > round_even(n * 50 / (SELECT count(*) FROM ent), 0) AS late FROM r JOIN n USING (country_norm))"""


@query(f"WITH {R.CANDIDATES}, {_QUOTA} SELECT s1_id, country_norm FROM q ORDER BY late, h, s1_id LIMIT 50")
def subsample_quota(spark, sf_dir):
    return matching.subsample(R.entities(R.norm(spark, sf_dir)).select("s1_id", "country_norm"), 50, 7)


@query(f"WITH {R.CANDIDATES} SELECT s1_id, ('0x' || substr(md5('3:' || s1_id), 1, 8))::BIGINT % 100 < 5 AS early_stop FROM ent")
def early_stop_mask(spark, sf_dir):
    return matching.early_stop(R.entities(R.norm(spark, sf_dir)).select("s1_id"), 5, 3)


@query(f"WITH {R.CANDIDATES} SELECT s1_id FROM ent ORDER BY md5('4:' || s1_id), s1_id LIMIT 40")
def uniform_sample(spark, sf_dir):
    return matching.uniform_sample(R.entities(R.norm(spark, sf_dir)).select("s1_id"), 40, 4)


@query(f"WITH {R.CANDIDATES} SELECT DISTINCT country_norm FROM norm WHERE country_norm <> ''")
def training_countries(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    found = matching.training_countries(n, R.entities(n))
    return spark.createDataFrame([(c,) for c in found], "country_norm string")


@query(f"WITH {R.CANDIDATES}, p AS (SELECT s1_id, count(*) AS n, count(c.pool_id) AS h FROM truth t LEFT JOIN cand c USING (s1_id, pool_id) GROUP BY s1_id), e AS (SELECT s1_id, s1_id IN (SELECT s1_id FROM truth) AS t, s1_id IN (SELECT s1_id FROM cand) AS c FROM ent) SELECT sum(h) / sum(n) AS pair_recall, avg(CAST(h = n AS DOUBLE)) AS entity_full_recall, (SELECT avg(CAST(NOT t AS DOUBLE)) FROM e) AS singleton_share, (SELECT avg(CAST(NOT c AS DOUBLE)) FROM e WHERE t) AS no_candidate_share FROM p")
def recall_detail(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.recall_detail(R.truth(n), R.candidates(n), R.entities(n))


@query(f"WITH {R.CANDIDATES}, t2 AS (SELECT s1_id, pool_id FROM truth UNION ALL SELECT s1_id, 'S2-unknown' FROM ent WHERE country_norm = 'us' UNION ALL SELECT 'S1-unknown', min(pool_id) FROM pl) SELECT t2.* FROM t2 WHERE s1_id NOT IN (SELECT s1_id FROM ent) OR pool_id NOT IN (SELECT pool_id FROM pl)")
def dangling_truth(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    e, p = R.entities(n), R.pool(n)
    more = R.truth(n).unionByName(e.where("country_norm = 'us'").select("s1_id", F.lit("S2-unknown").alias("pool_id"))).unionByName(p.agg(F.min("pool_id").alias("pool_id")).select(F.lit("S1-unknown").alias("s1_id"), "pool_id"))
    return matching.dangling(more, e, p)


@query(f"WITH {R.CANDIDATES}, l AS (SELECT c.s1_id, c.pool_id, CAST(t.s1_id IS NOT NULL AS INTEGER) AS label FROM cand c LEFT JOIN truth t ON c.s1_id = t.s1_id AND c.pool_id = t.pool_id) SELECT s1_id, pool_id, label FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, label ORDER BY md5('1:' || s1_id || '/' || pool_id), pool_id) AS r FROM l) WHERE label = 1 OR r <= 3")
def neg_sampling(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.sample_negatives(matching.label(R.candidates(n).drop("evidence"), R.truth(n)), 3, 1)


@query(f"WITH {R.CLAIMS} SELECT s1_id, pool_id, score FROM claims")
def overlap_claims(spark, sf_dir):
    return R.claims(R.norm(spark, sf_dir))


@query(f"WITH {R.OWNED} SELECT s1_id, pool_id, score FROM owned")
def resolve_competition(spark, sf_dir):
    return _owned(R.norm(spark, sf_dir))


@query(f"WITH {R.OWNED} SELECT s1_id AS source1_entity_id, coalesce(string_agg(pool_id, ',' ORDER BY pool_id), '') AS matched_entity_ids FROM ent LEFT JOIN owned USING (s1_id) GROUP BY s1_id")
def matching_results(spark, sf_dir):
    return _lists(R.norm(spark, sf_dir))


@query(f"WITH {R.SCORES} SELECT s1_id, n_true, n_pred, n_hit, round(f05, 9) AS f05 FROM scores")
def per_entity_f05(spark, sf_dir):
    return _scores(R.norm(spark, sf_dir)).withColumn("f05", F.round("f05", 9))


@query(f"WITH {R.SCORES} SELECT round(avg(f05), 9) AS macro_f05, round(sum(n_hit) / sum(n_pred), 9) AS precision, round(sum(n_hit) / sum(n_true), 9) AS recall, round(avg(CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS DOUBLE) END), 9) AS singleton_accuracy, count(*) FILTER (n_pred = 0) AS empty_predictions FROM scores")
def macro_f05(spark, sf_dir):
    r = lambda c: F.round(c, 9).alias(c)
    return matching.summary(_scores(R.norm(spark, sf_dir))).select(r("macro_f05"), r("precision"), r("recall"), r("singleton_accuracy"), "empty_predictions")


@query(f"WITH {R.SCORES}, s AS (SELECT * FROM scores JOIN ent USING (s1_id) WHERE country_norm = 'us') SELECT round(avg(f05), 9) AS macro_f05, round(sum(n_hit) / sum(n_pred), 9) AS precision, round(sum(n_hit) / sum(n_true), 9) AS recall, round(avg(CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS DOUBLE) END), 9) AS singleton_accuracy, count(*) FILTER (n_pred = 0) AS empty_predictions FROM s")
def subset_f05(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    r = lambda c: F.round(c, 9).alias(c)
    return matching.subset_score(_scores(n), R.entities(n).where("country_norm = 'us'")).select(r("macro_f05"), r("precision"), r("recall"), r("singleton_accuracy"), "empty_predictions")


@query(f"WITH {R.SCORES} SELECT sum(n_hit)::BIGINT AS true_positives, sum(n_pred - n_hit)::BIGINT AS false_positives, sum(n_true - n_hit)::BIGINT AS false_negatives, round(sum(n_hit) / sum(n_pred), 9) AS precision, round(sum(n_hit) / sum(n_true), 9) AS recall FROM scores")
def counts_against_truth(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    out = matching.against_truth(R.entities(n), R.truth(n), _owned(n))
    return out.select("true_positives", "false_positives", "false_negatives", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_SWEEP = f"""WITH {R.CLAIMS}, grid AS (SELECT unnest({GRID}::DOUBLE[]) AS threshold),
own AS (SELECT s1_id, pool_id, score FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY score DESC, s1_id) AS r FROM claims) WHERE r = 1),
nt AS (SELECT e.s1_id, count(t.pool_id) AS n_true FROM ent e LEFT JOIN truth t USING (s1_id) GROUP BY 1),
h AS (SELECT o.s1_id, o.score, t.pool_id IS NOT NULL AS hit FROM own o LEFT JOIN truth t USING (s1_id, pool_id)),
c AS (SELECT threshold, n.s1_id, any_value(n_true) AS n_true, count(h.s1_id) AS n_pred, count(*) FILTER (h.hit) AS n_hit FROM grid CROSS JOIN nt n LEFT JOIN h ON h.s1_id = n.s1_id AND h.score >= threshold GROUP BY threshold, n.s1_id)
SELECT threshold, round(avg({R.F05}), 9) AS macro_f05 FROM c GROUP BY threshold"""


@query(_SWEEP)
def threshold_sweep_resolved(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.threshold_sweep(R.claims(n), R.truth(n), R.entities(n), GRID).withColumn("macro_f05", F.round("macro_f05", 9))


@query(f"WITH {R.OWNED}, w AS (SELECT o.s1_id, string_agg(CASE WHEN t.pool_id IS NULL THEN o.pool_id END, ',' ORDER BY o.pool_id) AS wrong, count(*) FILTER (t.pool_id IS NULL) / count(*) AS share FROM owned o LEFT JOIN truth t USING (s1_id, pool_id) GROUP BY 1) SELECT s1_id, wrong, share FROM w WHERE share > 0 ORDER BY share DESC, s1_id LIMIT 20")
def error_false_merges(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.errors(R.truth(n), _owned(n), "false_merges")


@query(f"WITH {R.OWNED}, w AS (SELECT t.s1_id, string_agg(CASE WHEN o.pool_id IS NULL THEN t.pool_id END, ',' ORDER BY t.pool_id) AS wrong, count(*) FILTER (o.pool_id IS NULL) / count(*) AS share FROM truth t LEFT JOIN owned o USING (s1_id, pool_id) GROUP BY 1) SELECT s1_id, wrong, share FROM w WHERE share > 0 ORDER BY share DESC, s1_id LIMIT 20")
def error_missed(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.errors(R.truth(n), _owned(n), "missed")


@query(f"WITH {R.OWNED}, w AS (SELECT o.s1_id, string_agg(o.pool_id, ',' ORDER BY o.pool_id) AS wrong FROM owned o WHERE o.s1_id NOT IN (SELECT s1_id FROM truth) GROUP BY 1) SELECT s1_id, wrong, 1.0 AS share FROM w ORDER BY s1_id LIMIT 20")
def error_singleton_merges(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.errors(R.truth(n), _owned(n), "singleton_merges")


@query(f"WITH {R.OWNED}, w AS (SELECT t.s1_id, list(t.pool_id ORDER BY t.pool_id) FILTER (o.pool_id IS NULL) AS ids, count(*) FILTER (o.pool_id IS NULL) / count(*) AS share FROM truth t LEFT JOIN owned o USING (s1_id, pool_id) GROUP BY 1), few AS (SELECT * FROM w WHERE share > 0 ORDER BY share DESC, s1_id LIMIT 20), x AS (SELECT entity_id, concat_ws(' | ', name_norm, address_core) AS text FROM norm) SELECT s1_id, array_to_string(ids, ',') AS wrong, share, a.text, (SELECT string_agg(i || '=' || x.text, '; ' ORDER BY i || '=' || x.text) FROM (SELECT unnest(ids) AS i) u JOIN x ON x.entity_id = i) AS wrong_text FROM few JOIN x a ON a.entity_id = s1_id")
def error_missed_text(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    return matching.with_record_text(matching.errors(R.truth(n), _owned(n), "missed"), n)


_DIRTY = f"""WITH {R.NORM}, e AS (SELECT entity_id AS s1_id, CAST(substr(entity_id, 4) AS BIGINT) AS k FROM norm WHERE source = 1), p AS (SELECT min(entity_id) AS id FROM norm WHERE source > 1),
d AS (SELECT s1_id, k, CASE WHEN k % 5 = 0 THEN id || ',' || id WHEN k % 7 = 0 THEN 'S2-x' WHEN k % 11 = 0 THEN s1_id ELSE '' END AS ids FROM e, p WHERE k % 13 <> 0)"""
_DIRTY_SQL = f"""{_DIRTY} SELECT 'duplicate_rows' AS "check", 'error' AS level, count(*) FILTER (k % 17 = 0) AS n FROM d
UNION ALL SELECT 'duplicate_ids', 'error', count(*) FILTER (k % 5 = 0) FROM d
UNION ALL SELECT 'self_matches', 'error', (sum(CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END) FILTER (ids = s1_id))::BIGINT FROM d
UNION ALL SELECT 'bad_prefix', 'error', (sum(CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END) FILTER (ids = s1_id))::BIGINT FROM d
UNION ALL SELECT 'unknown_ids', 'error', (sum(CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END) FILTER (ids = s1_id OR ids = 'S2-x'))::BIGINT FROM d
UNION ALL SELECT 'missing_entities', 'error', count(*) FILTER (k % 13 = 0) FROM e
UNION ALL SELECT 'extra_entities', 'error', 1
UNION ALL SELECT 'matches_outside_candidates', 'warning', count(*) FILTER (k % 5 <> 0 AND ids <> '') FROM d"""


@query(_DIRTY_SQL)
def validate_dirty(spark, sf_dir):
    """A file with every kind of fault, written and read as a delivered one."""
    n = R.norm(spark, sf_dir)
    e, p = R.entities(n).select("s1_id"), R.pool(n).select("pool_id")
    k = F.substr(F.col("s1_id"), F.lit(4)).cast("long")
    first = p.agg(F.min("pool_id").alias("id"))  # one row
    ids = F.when(k % 5 == 0, F.concat_ws(",", "id", "id")).when(k % 7 == 0, "S2-x").when(k % 11 == 0, F.col("s1_id")).otherwise("")
    rows = e.crossJoin(F.broadcast(first)).where(k % 13 != 0)
    dirty = rows.select(F.col("s1_id").alias("source1_entity_id"), ids.alias("matched_entity_ids"))
    dirty = dirty.unionByName(dirty.where(F.substr(F.col("source1_entity_id"), F.lit(4)).cast("long") % 17 == 0)).unionByName(spark.createDataFrame([("S1-nobody", "")], dirty.schema))
    at = fresh_path(spark, "dirty")
    sources.write_lists(dirty, at)
    held = rows.where(k % 5 == 0).select(F.col("s1_id").alias("source1_entity_id"), F.col("id").alias("candidate_entity_ids"))
    found = matching.violations(sources.read_lists(spark, at), e, p, candidates=held)
    return found.select("check", "level", "n")


#: A small run: fewer and shallower trees than the defaults of a full one.
_SMALL = flow.Options(rounds=5, depth=3, fraction=0.3, n_train=1000, n_validation=500, grid=tuple(matching.COARSE_GRID))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', 0)" for c in ("duplicate_rows", "duplicate_ids", "self_matches", "bad_prefix", "unknown_ids", "missing_entities", "extra_entities", "matches_outside_candidates")) + ') v("check", n)')
def trained_lists_valid(spark, sf_dir):
    """Trains, saves, loads, predicts, writes both files, reads and checks them."""
    n = settle(R.norm(spark, sf_dir), "norm")
    at = fresh_path(spark, "run")
    pairs = flow.candidates(n, _SMALL)
    flow.train(n, settle(R.truth(n), "truth"), f"{at}/model", _SMALL, pairs)
    lists, held = flow.predict(n, f"{at}/model", at, _SMALL, pairs=pairs)
    return matching.violations(lists, R.entities(n), R.pool(n), candidates=held).select("check", F.col("n").cast("int").alias("n"))


@query("SELECT * FROM (VALUES ('duplicate_rows', 0), ('duplicate_ids', 0), ('self_matches', 0), ('bad_prefix', 0), ('unknown_ids', 0), ('missing_entities', 0), ('extra_entities', 0)) v(\"check\", n)")
def validate_violations(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    at = fresh_path(spark, "lists")
    sources.write_lists(_lists(n), at)
    return matching.violations(sources.read_lists(spark, at), R.entities(n), R.pool(n)).select("check", F.col("n").cast("int").alias("n"))


@query()
def gbt_scores(spark, sf_dir):
    """Trains on all candidates and scores them. What training reads again and again is written first, not planned anew each time."""
    with freed_shuffles(spark):
        n = settle(R.norm(spark, sf_dir), "norm")
        pairs = settle(matching.label(R.candidates(n), R.truth(n)), "labelled")
        rows = features.settled(pairs, n, ["us", "france"], keep=("label",))
    return model.predict(model.train(rows, rounds=5, depth=4), rows)


# Profiles


@query(f"WITH {R.RECORDS} SELECT country, count(*) AS n, count(*) FILTER (business_name = '') AS no_name, count(*) FILTER (business_address = '') AS no_address, avg(length(business_name)) AS mean_name_length FROM rec GROUP BY 1")
def eda_profile(spark, sf_dir):
    return profile.by_country(R.records(spark, sf_dir))


@query(f"WITH {R.CANDIDATES}, k AS (SELECT e.s1_id, count(t.pool_id) AS size FROM ent e LEFT JOIN truth t USING (s1_id) GROUP BY 1) SELECT CAST(size AS INTEGER) AS size, count(*) AS entities FROM k GROUP BY 1")
def eda_list_sizes(spark, sf_dir):
    n = R.norm(spark, sf_dir)
    lists = R.entities(n).select("s1_id").join(R.truth(n).groupBy("s1_id").agg(F.collect_set("pool_id").alias("m")), "s1_id", "left")
    return profile.list_sizes(lists.select("s1_id", F.coalesce("m", F.array().cast("array<string>")).alias("matches")))


@query(f"WITH {R.NORM}, t AS (SELECT DISTINCT entity_id, unnest(list_filter(string_split(name_norm, ' '), lambda t: t <> '')) AS token FROM norm) SELECT token, count(*) AS records FROM t GROUP BY 1")
def eda_token_df(spark, sf_dir):
    return profile.token_frequency(R.norm(spark, sf_dir))


@query(f"WITH {R.RECORDS} SELECT " + ", ".join(f"quantile_cont(length({c}), {p}) AS {n}_p{s}" for c, n in (("business_name", "name"), ("business_address", "address")) for p, s in ((0.5, "50"), (0.9, "90"), (0.99, "99"), (0.999, "99_9"))) + " FROM rec")
def eda_len_quantiles(spark, sf_dir):
    return profile.length_quantiles(R.records(spark, sf_dir))


@query(f"WITH {R.NORM} SELECT name_norm, count(*) AS records FROM norm WHERE name_norm <> '' GROUP BY 1 HAVING count(*) > 1")
def eda_dup_names(spark, sf_dir):
    return profile.duplicate_names(R.norm(spark, sf_dir))


@query(f"WITH {R.CANDIDATES} SELECT pool_id, count(*) AS owners FROM truth GROUP BY 1 HAVING count(*) > 1")
def eda_contention(spark, sf_dir):
    return profile.contention(R.truth(R.norm(spark, sf_dir)))
