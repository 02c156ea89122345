"""The queries op1 to op10 over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, decontamination, html_text, near_duplicates, packing, ppm, pseudonyms, quality_rules, sharding, token_files
from .shared import drop_table, settle, table

#: A key for tests and examples. In production the caller's secret store gives it.
EXAMPLE_KEY = "kinloom example key"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether it passes the base rule and the list learned from all labels."""
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document occurs in the benchmark."""
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model and by the token baseline, both of the documents not held out."""
    return ppm.score(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by four-word shingles."""
    return near_duplicates.groups(table(spark, sf_dir, "documents"), size=4)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learned from labelled rows that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model = compression_quality.fit(docs.where("not held_out"), table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the files."""
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with personal values permuted, n_values (how many)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, EXAMPLE_KEY, count="n_values")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every document, by the law `bytes`."""
    packed = sharding.shard(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The stages of the corpus pipeline. Each takes documents and gives what it keeps of them; nulls, empty texts, repeated
# rows and empty tables have the results that its operator defines.


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the rules learned; null and empty texts fail the base rule."""
    rules = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, rules)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group by five-word shingles; all rows of a doc_id stay or go together."""
    return near_duplicates.deduplicate(docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def stage_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal values permuted; n_chars is made anew."""
    out = pseudonyms.pseudonymise(docs, EXAMPLE_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of every document; see packing.pack."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontamination),
    ("pseudonyms", stage_pseudonyms),
    ("packing", stage_packing),
]


def run_stages(spark: SparkSession, sf_dir: str, stages=None) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again, and dropped when the next one's is.

    An empty table passes all stages and gives no row.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1] if stages is None else stages[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop_table(last)
        last = docs
    return (STAGES if stages is None else stages)[-1][1](spark, docs, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_html_text, op4_lm_scoring, op5_packing, op6_near_duplicates, op7_quality_classifier, op8_token_files, op9_pseudonyms, op10_sharding)}

#: Words as decontamination reads them, in DuckDB: A-Z in lower case, then runs of digits, a-z and what lies beyond ASCII.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = {
    "op2_decontamination": rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.n, g.i, x.item FROM grams g JOIN windows x ON g.n = x.n AND g.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN owners o ON d.doc_id = o.doc_id""",
    "op6_near_duplicates": r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM docs),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ends AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS component FROM documents UNION SELECT e.v, r.component FROM reach r JOIN ends e ON r.node = e.u),
least_of AS (SELECT node, min(component) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component AS component_id, s.doc_id = l.component AS kept
FROM sets s JOIN least_of l ON s.doc_id = l.node""",
}
