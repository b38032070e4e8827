"""State transitions of links and rules as queries, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import decisions as X
from larkspan.operators import synonyms as Y
from larkspan.operators import transitions as M
from larkspan.operators import versions as V
from larkspan.plans.registry import query
from larkspan.sources import adapters as A
from larkspan.sources.shared import written

_ID = "spec_id * 1000000 + supplier_id"
_LINKS = f""", l0 AS (SELECT {_ID} AS id, spec_id, min(source) AS source, supplier_id * 10 + spec_id % 10 AS offer_id, supplier_id, max(score) AS confidence, max(confirmed) AS confirmed, max(analog) AS is_analog FROM matched GROUP BY spec_id, supplier_id),
 links AS (SELECT id, spec_id, source, offer_id, supplier_id, confidence / 100.0 AS confidence, CASE WHEN confidence >= 95 THEN 'exact_article' ELSE 'name_similarity' END AS match_type, CAST(confirmed = 1 AND (id % 5) < 1 AS INT) AS is_confirmed, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY confidence DESC, id) = 1 AS INT) AS is_selected, is_analog FROM l0)"""
_COLUMNS = "id, spec_id, source, offer_id, supplier_id, confidence, match_type, is_confirmed, is_selected, is_analog"


def links(spark: SparkSession, d: str) -> DataFrame:
    """One link a (spec, supplier); a fifth of the confirmable ones is confirmed, the best of a spec is selected."""
    t = A.matched(spark, d).groupBy("spec_id", "supplier_id").agg(F.min("source").alias("source"), F.max("score").alias("score"), F.max("confirmed").alias("confirmed"), F.max("analog").alias("is_analog")).withColumn("id", F.expr(_ID))
    t = t.selectExpr("id", "spec_id", "source", "supplier_id * 10 + spec_id % 10 AS offer_id", "supplier_id", "CAST(score AS DOUBLE) / 100 AS confidence", "CASE WHEN score >= 95 THEN 'exact_article' ELSE 'name_similarity' END AS match_type", "CAST(confirmed = 1 AND (id % 5) < 1 AS INT) AS is_confirmed", "is_analog")
    best = t.groupBy("spec_id").agg(F.max_by("id", F.struct("confidence", -F.col("id"))).alias("best"))
    return t.join(best, "spec_id").withColumn("is_selected", (F.col("id") == F.col("best")).cast("int")).select(*_COLUMNS.split(", "))


def _chosen(links_: DataFrame) -> DataFrame:
    """The links that an operator names: the least id of every seventh spec."""
    return links_.where("spec_id % 7 = 0").groupBy("spec_id").agg(F.min("id").alias("id")).select("id")


_CHOSEN = ", chosen AS (SELECT min(id) AS id FROM links WHERE spec_id % 7 = 0 GROUP BY spec_id), touched AS (SELECT DISTINCT spec_id FROM links WHERE id IN (SELECT id FROM chosen))"
_CANDIDATES = ", c AS (SELECT id + 500000 AS id, spec_id, source, offer_id + 1 AS offer_id, supplier_id, confidence, match_type, is_analog, CAST(id % 3 AS INT) - 1 AS dn_score, CAST(id % 2 AS INT) AS quantity_score FROM links)"


def _candidates(links_: DataFrame) -> DataFrame:
    return links_.selectExpr("id + 500000 AS id", "spec_id", "source", "offer_id + 1 AS offer_id", "supplier_id", "confidence", "match_type", "is_analog", "CAST(id % 3 AS INT) - 1 AS dn_score", "CAST(id % 2 AS INT) AS quantity_score")


_NEW = " SELECT id, spec_id, source, offer_id, supplier_id, confidence, match_type, 0 AS is_confirmed, CAST(row_number() OVER (PARTITION BY spec_id ORDER BY dn_score DESC, quantity_score DESC, confidence DESC, offer_id, source) = 1 AS INT) AS is_selected, is_analog FROM c WHERE spec_id NOT IN (SELECT spec_id FROM links WHERE is_confirmed = 1)"


@query("matched", _LINKS + _CANDIDATES + f" SELECT {_COLUMNS} FROM links WHERE is_confirmed = 1 UNION ALL" + _NEW)
def run_matching_full(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.run_matching(t, _candidates(t))


@query("matched", _LINKS + _CANDIDATES + f" SELECT {_COLUMNS} FROM links WHERE is_confirmed = 1 OR spec_id IN (SELECT spec_id FROM links WHERE is_confirmed = 1) UNION ALL" + _NEW)
def run_matching_incremental(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.run_matching(t, _candidates(t), incremental=True)


def _after(confirmed: str, selected: str, analog: str) -> str:
    pick = lambda x, c: f"CASE WHEN id IN (SELECT id FROM chosen) THEN {x} ELSE {c} END"
    sel = f"CASE WHEN spec_id IN (SELECT spec_id FROM touched) THEN CAST(id IN (SELECT id FROM chosen) AS INT) ELSE is_selected END" if selected else "is_selected"
    return _LINKS + _CHOSEN + f" SELECT id, spec_id, source, offer_id, supplier_id, confidence, match_type, {pick(confirmed, 'is_confirmed')} AS is_confirmed, {sel} AS is_selected, {pick(analog, 'is_analog')} AS is_analog FROM links"


@query("matched", _after("1", "y", "0"))
def confirm_bulk(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.confirm(t, _chosen(t))


@query("matched", _after("1", "y", "1"))
def confirm_analog(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.confirm(t, _chosen(t), analog=True)


@query("matched", _after("0", "", "is_analog").replace("is_selected AS is_selected", "CASE WHEN id IN (SELECT id FROM chosen) THEN 0 ELSE is_selected END AS is_selected"))
def unconfirm(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.unconfirm(t, _chosen(t))


@query("matched", _after("is_confirmed", "y", "is_analog"))
def select_price(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.select_price(t, _chosen(t))


@query("matched", _LINKS + _CHOSEN + f" SELECT {_COLUMNS} FROM links WHERE id NOT IN (SELECT id FROM chosen)")
def reject_bulk(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    return M.reject(t, _chosen(t))


@query("matched", _LINKS + """, p AS (SELECT spec_id, max(offer_id) + CASE WHEN spec_id % 2 = 0 THEN 0 ELSE 3 END AS offer_id, max(supplier_id) AS supplier_id FROM links WHERE spec_id % 11 = 0 GROUP BY spec_id),
 known AS (SELECT l.* FROM links l JOIN p ON p.spec_id = l.spec_id AND p.offer_id = l.offer_id WHERE coalesce(l.source, 'invoice') = 'invoice'), new AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.spec_id = p.spec_id AND k.offer_id = p.offer_id))
 SELECT spec_id, offer_id, confidence, match_type, CASE WHEN id IN (SELECT id FROM known) THEN 1 ELSE is_confirmed END AS is_confirmed, CASE WHEN spec_id IN (SELECT spec_id FROM known) THEN CAST(id IN (SELECT id FROM known) AS INT) WHEN spec_id IN (SELECT spec_id FROM new) THEN 0 ELSE is_selected END AS is_selected FROM links
 UNION ALL SELECT spec_id, offer_id, 1.0, 'manual', 1, 1 FROM new""")
def manual_match(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    pairs = t.where("spec_id % 11 = 0").groupBy("spec_id").agg(F.max("offer_id").alias("offer_id"), F.max("supplier_id").alias("supplier_id")).withColumn("offer_id", F.expr("offer_id + CASE WHEN spec_id % 2 = 0 THEN 0 ELSE 3 END"))
    return M.manual_match(t, pairs)[0].select("spec_id", "offer_id", "confidence", "match_type", "is_confirmed", "is_selected")


@query("matched specs", _LINKS + """, g AS (SELECT name, min(spec_id) AS leader FROM specs GROUP BY name HAVING count(*) >= 2), best AS (SELECT g.name, g.leader, l.source, l.offer_id FROM g JOIN links l ON l.spec_id = g.leader AND l.is_selected = 1),
 f AS (SELECT s.spec_id, b.leader AS leader_id, b.source, b.offer_id FROM specs s JOIN best b USING (name) WHERE s.spec_id <> b.leader)
 SELECT f.spec_id, leader_id, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.spec_id = f.spec_id AND is_confirmed = 1) THEN 'conflicted' WHEN m.id IS NOT NULL THEN 'auto' ELSE 'skipped' END AS bucket, CASE WHEN NOT EXISTS (SELECT 1 FROM links l WHERE l.spec_id = f.spec_id AND is_confirmed = 1) THEN m.id END AS match_id
 FROM f LEFT JOIN (SELECT spec_id, source, offer_id, min(id) AS id FROM links GROUP BY ALL) m ON m.spec_id = f.spec_id AND m.source = f.source AND m.offer_id = f.offer_id""")
def group_confirm_buckets(spark: SparkSession, d: str) -> DataFrame:
    t, s = links(spark, d), A.specs(spark, d).select("spec_id", "name")
    leaders = s.groupBy("name").agg(F.min("spec_id").alias("leader_id"), F.count("*").alias("n")).where("n >= 2").drop("n")
    best = leaders.join(t.where("is_selected = 1").selectExpr("spec_id AS leader_id", "source", "offer_id"), "leader_id")
    return M.group_confirm(t, s.join(best, "name").where("spec_id <> leader_id").drop("name"))


_RULES = """, rules AS (SELECT p_name AS spec_pattern, code AS offer_pattern, CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE supplier_id % 5 END AS supplier_id, max(score) / 100.0 AS confidence, CAST(count(*) % 4 AS INT) AS times_used, CAST(min(row_index) % 2 AS INT) AS is_negative, CAST(max(row_index) % 3 AS INT) // 2 AS is_analog, CASE WHEN min(invoice_id) % 2 = 0 THEN 'import' ELSE 'manual' END AS source
  FROM matched JOIN specs USING (spec_id) WHERE spec_id % 3 <> 1 GROUP BY 1, 2, 3), news AS (SELECT DISTINCT p_name AS spec_pattern, code AS offer_pattern, CASE WHEN spec_id % 4 = 0 THEN NULL ELSE spec_id % 5 END AS supplier_id, 0.92 AS confidence, 'manual' AS source FROM specs WHERE spec_id % 3 <> 2)"""
_JOINED = " FROM rules o FULL JOIN news n ON o.spec_pattern = n.spec_pattern AND o.offer_pattern = n.offer_pattern AND o.supplier_id IS NOT DISTINCT FROM n.supplier_id"
_KEYS = " SELECT coalesce(o.spec_pattern, n.spec_pattern) AS spec_pattern, coalesce(o.offer_pattern, n.offer_pattern) AS offer_pattern, coalesce(o.supplier_id, n.supplier_id) AS supplier_id"


def _rules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    specs = A.specs(spark, d).select("spec_id", F.col("p_name").alias("spec_pattern"), F.col("code").alias("offer_pattern"))
    r = A.matched(spark, d).where("spec_id % 3 <> 1").join(specs, "spec_id").withColumn("scope", F.expr("CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE supplier_id % 5 END"))
    r = r.groupBy("spec_pattern", "offer_pattern", F.col("scope").alias("supplier_id")).agg(F.expr("CAST(max(score) AS DOUBLE) / 100").alias("confidence"), F.expr("CAST(count(*) % 4 AS INT)").alias("times_used"), F.expr("CAST(min(row_index) % 2 AS INT)").alias("is_negative"), F.expr("CAST(max(row_index) % 3 AS INT) div 2").cast("int").alias("is_analog"), F.expr("CASE WHEN min(invoice_id) % 2 = 0 THEN 'import' ELSE 'manual' END").alias("source"))
    n = specs.where("spec_id % 3 <> 2").selectExpr("spec_pattern", "offer_pattern", "CASE WHEN spec_id % 4 = 0 THEN NULL ELSE spec_id % 5 END AS supplier_id").distinct().withColumns({"confidence": F.lit(0.92), "source": F.lit("manual")})
    return r, n


@query("matched specs", _RULES + _KEYS + """, CASE WHEN n.spec_pattern IS NULL THEN o.confidence WHEN o.spec_pattern IS NULL OR o.is_negative = 1 OR o.is_analog = 1 OR o.confidence < n.confidence THEN n.confidence ELSE least(0.97, o.confidence + 0.02) END AS confidence,
 CASE WHEN n.spec_pattern IS NULL THEN o.times_used ELSE coalesce(o.times_used, 0) + 1 END AS times_used, CASE WHEN n.spec_pattern IS NULL THEN o.is_negative ELSE 0 END AS is_negative, CASE WHEN n.spec_pattern IS NULL THEN o.is_analog ELSE 0 END AS is_analog, CASE WHEN n.spec_pattern IS NULL OR o.source = 'import' THEN o.source ELSE n.source END AS source""" + _JOINED)
def rule_upsert_sticky(spark: SparkSession, d: str) -> DataFrame:
    return M.upsert_positive(*_rules(spark, d))


@query("matched specs", _RULES.replace("WHERE spec_id % 3 <> 2)", "WHERE spec_id % 3 <> 2 AND spec_id % 4 <> 0)") + _KEYS + """, CASE WHEN n.spec_pattern IS NULL THEN o.confidence ELSE 0 END AS confidence, CASE WHEN n.spec_pattern IS NULL THEN o.times_used ELSE coalesce(o.times_used, 0) + 1 END AS times_used,
 CASE WHEN n.spec_pattern IS NULL THEN o.is_negative ELSE 1 END AS is_negative, CASE WHEN n.spec_pattern IS NULL THEN o.is_analog ELSE 0 END AS is_analog, CASE WHEN n.spec_pattern IS NULL THEN o.source ELSE 'reject' END AS source""" + _JOINED)
def rule_upsert_negative(spark: SparkSession, d: str) -> DataFrame:
    r, n = _rules(spark, d)
    return M.upsert_negative(r, n.select(*M.RULE_KEY))


@query("matched specs", _RULES + _KEYS + """, CASE WHEN n.spec_pattern IS NULL THEN o.confidence ELSE 0.75 END AS confidence, CASE WHEN n.spec_pattern IS NULL THEN o.times_used ELSE coalesce(o.times_used, 0) + 1 END AS times_used,
 CASE WHEN n.spec_pattern IS NULL THEN o.is_negative ELSE 0 END AS is_negative, CASE WHEN n.spec_pattern IS NULL THEN o.is_analog ELSE 1 END AS is_analog, CASE WHEN n.spec_pattern IS NULL THEN o.source ELSE 'manual' END AS source""" + _JOINED)
def rule_upsert_analog(spark: SparkSession, d: str) -> DataFrame:
    r, n = _rules(spark, d)
    return M.upsert_analog(r, n.select(*M.RULE_KEY))


@query("matched specs", _RULES + """ SELECT o.spec_pattern, o.offer_pattern, o.supplier_id, o.confidence, CASE WHEN n.spec_pattern IS NOT NULL AND o.is_negative = 0 AND o.times_used > 1 THEN o.times_used - 1 ELSE o.times_used END AS times_used, o.is_negative, o.is_analog, o.source
 FROM rules o LEFT JOIN news n ON o.spec_pattern = n.spec_pattern AND o.offer_pattern = n.offer_pattern AND o.supplier_id IS NOT DISTINCT FROM n.supplier_id WHERE NOT (n.spec_pattern IS NOT NULL AND o.is_negative = 0 AND o.times_used <= 1 AND o.source <> 'import')""")
def rule_use_rollback(spark: SparkSession, d: str) -> DataFrame:
    return M.roll_back_use(*_rules(spark, d))


@query("matched", _LINKS + """, band AS (SELECT id FROM links WHERE is_confirmed = 0 AND confidence >= 0.6 AND confidence < 0.75 ORDER BY confidence DESC, id LIMIT 5)
 SELECT id, spec_id, CASE WHEN id IN (SELECT id FROM band) THEN 0.7 ELSE confidence END AS confidence FROM links WHERE NOT (id IN (SELECT id FROM band) AND id % 2 = 1)""")
def judge_weak_links(spark: SparkSession, d: str) -> DataFrame:
    t = links(spark, d)
    answers = t.select("id", F.expr("CASE WHEN id % 2 = 1 THEN 'no' ELSE 'yes' END").alias("answer"))
    return M.judged(t, answers, 0.6, 0.75).select("id", "spec_id", "confidence")


@query("matched", _LINKS + """ SELECT spec_id, offer_id, CASE match_type WHEN 'exact_article' THEN 'article ' || CAST(floor(confidence * 100 + 0.5) AS INT) || '%' WHEN 'name_similarity' THEN 'name ' || CAST(floor(confidence * 100 + 0.5) AS INT) || '%' ELSE 'unknown' END AS reason FROM links WHERE is_selected = 1""")
def match_reasons(spark: SparkSession, d: str) -> DataFrame:
    percent = F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("int").cast("string"), F.lit("%"))
    reason = F.when(F.col("match_type") == "exact_article", F.concat(F.lit("article "), percent)).when(F.col("match_type") == "name_similarity", F.concat(F.lit("name "), percent)).otherwise("unknown")
    return links(spark, d).where("is_selected = 1").select("spec_id", "offer_id", reason.alias("reason"))


@query("matched specs", _LINKS + """ SELECT CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (is_confirmed = 1) AS BIGINT) AS confirmed, CAST(count(*) FILTER (spec_id NOT IN (SELECT spec_id FROM specs WHERE spec_id % 10 <> 3)) AS BIGINT) AS orphans FROM links""")
def link_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Links, confirmed ones, and those whose spec would be gone if the specs ending in 3 were."""
    kept = A.specs(spark, d).where("spec_id % 10 <> 3").select("spec_id").withColumn("kept", F.lit(1))
    return links(spark, d).join(kept, "spec_id", "left").agg(F.count("*").alias("links"), F.count(F.when(F.col("is_confirmed") == 1, 1)).alias("confirmed"), F.count(F.when(F.col("kept").isNull(), 1)).alias("orphans"))


# --- versions ---------------------------------------------------------------------------

_ITEMS = """ AS (SELECT CAST(l_orderkey * 1000 + n AS BIGINT) AS id, l_orderkey AS owner, CAST(n AS INT) AS position, spec_id, quantity FROM (SELECT l_orderkey, l_partkey AS spec_id, l_quantity AS quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM {0}) WHERE n < 1000)"""
#: Parsed anew: without the first line, quantities a half more.
_ANEW = "SELECT owner, position, spec_id, quantity * 1.5 AS quantity FROM {0} WHERE owner % 5 = 0 AND position > 1"
_VERSIONED = "WITH now" + _ITEMS.format("lineitem")


def _versioned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Items, snapshots, base and new rows: every fifth invoice is parsed anew, every third of these was changed meanwhile."""
    items = spark.sql("WITH now" + _ITEMS.format("{lines}") + " SELECT * FROM now", lines=A.read(spark, d, "lineitem"))
    before = items.withColumn("quantity", F.expr("CASE WHEN owner % 15 = 0 THEN quantity + 1 ELSE quantity END"))
    base = V.digests(before.where("owner % 5 = 0"))
    new = spark.sql(_ANEW.format("{items}"), items=items)
    none = spark.createDataFrame([], "owner long, version int, action string, snapshot string")
    return items, none, base, new


@query("", _VERSIONED + f""", anew AS ({_ANEW.format("now")}), came AS (SELECT (SELECT max(id) FROM now) + row_number() OVER (ORDER BY owner, position) AS id, * FROM anew WHERE owner % 15 <> 0)
 SELECT id, owner, position, spec_id, quantity, owner % 15 = 0 AS conflict FROM now WHERE owner % 5 <> 0 OR owner % 15 = 0 UNION ALL SELECT *, false FROM came""")
def reparse_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Items after invoices were parsed anew; those that were changed meanwhile are left alone and marked."""
    items, snapshots, base, new = _versioned(spark, d)
    after, _, conflicts = V.replaced(items, snapshots, base, new)
    return after.join(conflicts.withColumn("conflict", F.lit(True)), "owner", "left").select(*items.columns, F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("", _VERSIONED + f""", anew AS ({_ANEW.format("now")}), came AS (SELECT (SELECT max(id) FROM now) + row_number() OVER (ORDER BY owner, position) AS id, * FROM anew WHERE owner % 15 <> 0),
 mid AS (SELECT * FROM now WHERE owner % 5 <> 0 OR owner % 15 = 0 UNION ALL SELECT * FROM came), back AS (SELECT * FROM now WHERE owner % 10 = 0 AND owner % 15 <> 0)
 SELECT id, owner, position, spec_id, quantity, CASE WHEN owner % 5 = 0 AND owner % 15 <> 0 THEN CASE WHEN owner % 10 = 0 AND owner IN (SELECT owner FROM came) THEN 2 ELSE 1 END ELSE 0 END AS versions FROM mid WHERE NOT (owner % 10 = 0 AND owner % 15 <> 0)
 UNION ALL SELECT (SELECT max(id) FROM mid) + row_number() OVER (ORDER BY owner, id), owner, position, spec_id, quantity, CASE WHEN owner IN (SELECT owner FROM came) THEN 2 ELSE 1 END FROM back""")
def rollback_version(spark: SparkSession, d: str) -> DataFrame:
    """The same, after every tenth invoice has gone back to its first version; versions: the snapshots that its owner has."""
    items, snapshots, base, new = _versioned(spark, d)
    after, taken, _ = V.replaced(items, snapshots, base, new)
    after, taken = written(after, "items"), written(taken, "snapshots")
    back, all_ = V.restored(after, taken, taken.where("owner % 10 = 0").select("owner", "version"))
    n = all_.groupBy("owner").agg(F.count("*").cast("int").alias("versions"))
    return back.join(n, "owner", "left").na.fill(0, ["versions"]).select(*items.columns, "versions")


# --- decisions with what they teach ------------------------------------------------------

_NAMES = "SELECT id, CASE spec_id % 3 WHEN 0 THEN 'пп труба' WHEN 1 THEN 'кран' ELSE concat('насос ', CAST(spec_id % 5 AS STRING)) END AS spec_pattern, CASE WHEN spec_id % 10 = 9 THEN NULL WHEN spec_id % 3 = 0 THEN 'полипропилен труба' ELSE concat('изделие ', CAST(supplier_id % 4 AS STRING)) END AS offer_pattern FROM"
_RULES = "SELECT DISTINCT spec_pattern, offer_pattern, CAST(supplier_id AS BIGINT) AS supplier_id, CAST(CASE supplier_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.93 WHEN 2 THEN 0.96 END AS DOUBLE) AS confidence, CAST(1 + supplier_id % 3 AS INT) AS times_used, CAST(supplier_id % 5 = 0 AS INT) AS is_negative, CAST(supplier_id % 7 = 0 AS INT) AS is_analog, CASE supplier_id % 2 WHEN 0 THEN 'import' ELSE 'manual' END AS source FROM {0} WHERE offer_pattern IS NOT NULL AND supplier_id % 3 <> 1"
_MANY = ", chosen AS (SELECT id FROM links WHERE spec_id % 4 <> 1 AND is_analog = 0)"
_TOLD = f""", names AS ({_NAMES} links), linked AS (SELECT links.*, spec_pattern, offer_pattern FROM links JOIN names USING (id)), rules AS ({_RULES.format("linked")}), told AS (SELECT * FROM linked WHERE id IN (SELECT id FROM chosen) AND offer_pattern IS NOT NULL),
 k AS (SELECT spec_pattern, offer_pattern, supplier_id, count(*) AS n, count(*) FILTER (is_confirmed = 0) AS open FROM told GROUP BY ALL), j AS (SELECT r.*, k.n, k.open, coalesce(r.spec_pattern, k.spec_pattern) AS sp, coalesce(r.offer_pattern, k.offer_pattern) AS op, coalesce(r.supplier_id, k.supplier_id) AS su, r.spec_pattern IS NULL AS fresh FROM rules r FULL JOIN k ON r.spec_pattern = k.spec_pattern AND r.offer_pattern = k.offer_pattern AND r.supplier_id = k.supplier_id)"""


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Links, rules, an empty dictionary, the links that are decided on and the names of all."""
    t = links(spark, d)
    names = spark.sql(_NAMES + " {links}", links=t)
    rules = spark.sql(_RULES.format("{linked}"), linked=t.join(names, "id"))
    return t, rules, Y.seed(spark).where("false"), t.where("spec_id % 4 <> 1 AND is_analog = 0").select("id"), names


@query("matched", _LINKS + _MANY + _TOLD + """ SELECT sp AS spec_pattern, op AS offer_pattern, su AS supplier_id, CASE WHEN n IS NULL THEN confidence WHEN fresh OR is_negative = 1 OR is_analog = 1 OR confidence IS NULL OR confidence < 0.92 THEN CASE WHEN n = 1 THEN 0.92 ELSE least(0.97, 0.92 + 0.02 * (n - 1)) END ELSE least(0.97, confidence + 0.02 * n) END AS confidence,
 CAST(coalesce(times_used, 0) + coalesce(n, 0) AS INT) AS times_used, CASE WHEN n IS NULL THEN is_negative ELSE 0 END AS is_negative, CASE WHEN n IS NULL THEN is_analog ELSE 0 END AS is_analog, CASE WHEN n IS NULL OR source = 'import' THEN source ELSE 'manual' END AS source FROM j""")
def confirm_teaches_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules after many links were confirmed, several of them by the same names."""
    t, rules, words, chosen, names = _decided(spark, d)
    return X.confirmed(t, rules, words, chosen, names).rules


@query("matched", _LINKS + _MANY + _TOLD + " SELECT sp AS spec_pattern, op AS offer_pattern, su AS supplier_id, CASE WHEN open > 0 THEN 0.0 ELSE confidence END AS confidence, CAST(coalesce(times_used, 0) + CASE WHEN open > 0 THEN 1 ELSE 0 END AS INT) AS times_used, CASE WHEN open > 0 THEN 1 ELSE is_negative END AS is_negative, CASE WHEN open > 0 THEN 0 ELSE is_analog END AS is_analog, CASE WHEN open > 0 THEN 'reject' ELSE source END AS source FROM j WHERE NOT (fresh AND open = 0)")
def reject_teaches_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules after many links were rejected; names of confirmed ones teach nothing."""
    t, rules, words, chosen, names = _decided(spark, d)
    return X.rejected(t, rules, words, chosen, names).rules
