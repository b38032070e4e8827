"""The engine's queries over the star-schema tables, each beside the DuckDB SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import money as M
from larkspan.functions import text as T
from larkspan.operators.similarity import dice_join
from larkspan.plans.registry import QUERIES, SQL, query  # noqa: F401
from larkspan.sources import adapters as A

def pick(order: list[Column], *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


_LINE = "CASE WHEN incl = 0 AND rate > 0 THEN amount * (1 + rate / 100) ELSE amount END"
_PRICED = f", priced AS (SELECT m.*, incl, rate, floor({_LINE} / nullif(quantity, 0) * 100 + 0.5) / 100 AS unit_price FROM matched m JOIN suppliers USING (supplier_id))"
_BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, supplier_id, invoice_id, row_index, quantity, amount) AS rn FROM priced WHERE is_delivery = 0) WHERE rn = 1)"
_ORDER = lambda: [F.desc("score"), F.col("supplier_id"), F.col("invoice_id"), F.col("row_index"), F.col("quantity"), F.col("amount")]


def priced(spark: SparkSession, d: str) -> DataFrame:
    price = M.unit_price_with_vat(F.try_divide("amount", "quantity"), F.col("rate"), F.col("incl"), F.col("quantity"), F.col("amount"))
    return A.matched(spark, d).join(A.suppliers(spark, d), "supplier_id").withColumn("unit_price", price["price"])


def selected(spark: SparkSession, d: str, where: str = "is_delivery = 0") -> DataFrame:
    return priced(spark, d).where(where).withColumn("rn", pick(_ORDER(), "spec_id")).where("rn = 1")


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


# --- pricing ---------------------------------------------------------------


@query("items suppliers", f"""
SELECT invoice_id, row_index, spec_id, quantity, amount, floor({_LINE} / nullif(quantity, 0) * 100 + 0.5) / 100 AS unit_price, 'derived_unit' AS price_source FROM items JOIN suppliers USING (supplier_id)""")
def unit_price_with_vat(spark: SparkSession, d: str) -> DataFrame:
    p = M.unit_price_with_vat(*map(F.col, ("price", "rate", "incl", "quantity", "amount")))
    return A.items(spark, d).join(A.suppliers(spark, d), "supplier_id").select("invoice_id", "row_index", "spec_id", "quantity", "amount", p["price"].alias("unit_price"), p["source"].alias("price_source"))


@query("items suppliers", """
, t AS (SELECT *, CASE row_index % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS column_included FROM items JOIN suppliers USING (supplier_id))
SELECT invoice_id, row_index, spec_id, amount, CASE WHEN rate > 0 AND column_included AND incl = 0 THEN floor(amount / (1 + rate / 100) * 100 + 0.5) / 100 WHEN rate > 0 AND NOT column_included AND incl = 1 THEN floor(amount * (1 + rate / 100) * 100 + 0.5) / 100 ELSE amount END AS converted,
 coalesce((column_included AND incl = 0) OR (NOT column_included AND incl = 1), FALSE) AS mismatch FROM t""")
def vat_semantics_convert(spark: SparkSession, d: str) -> DataFrame:
    inc = F.when(F.col("row_index") % 3 == 0, F.lit(True)).when(F.col("row_index") % 3 == 1, F.lit(False))
    t = A.items(spark, d).join(A.suppliers(spark, d), "supplier_id")
    return t.select("invoice_id", "row_index", "spec_id", "amount", M.convert_vat(F.col("amount"), inc, F.col("rate"), F.col("incl")).alias("converted"), M.vat_mismatch(inc, F.col("incl")).alias("mismatch"))


@query("items", """
, t AS (SELECT *, floor(price * (1 + l_discount / 10) * 100 + 0.5) / 100 AS given FROM items)
SELECT invoice_id, row_index, spec_id, given, CASE WHEN quantity > 0 AND amount > 0 AND given > 0 AND abs(given - amount / quantity) / (amount / quantity) > 0.01 THEN floor(amount / quantity * 100 + 0.5) / 100 ELSE given END AS price FROM t""")
def price_rederive(spark: SparkSession, d: str) -> DataFrame:
    t = A.items(spark, d).withColumn("given", M.cents(F.expr("price * (1 + l_discount / 10)")))
    return t.select("invoice_id", "row_index", "spec_id", "given", M.rederived_price(F.col("given"), F.col("quantity"), F.col("amount")).alias("price"))


@query("items", """
, t AS (SELECT invoice_id, row_index, spec_id, CASE WHEN row_index % 3 <> 0 THEN quantity END AS q, CASE WHEN row_index % 3 <> 1 THEN floor(price * 100 + 0.5) / 100 END AS p, CASE WHEN row_index % 3 <> 2 THEN amount END AS a FROM items),
u AS (SELECT *, coalesce(a, floor(q * p * 100 + 0.5) / 100) AS a2 FROM t), v AS (SELECT *, coalesce(p, CASE WHEN q > 0 THEN floor(a2 / q * 100 + 0.5) / 100 END) AS p2 FROM u)
SELECT invoice_id, row_index, spec_id, coalesce(q, CASE WHEN p2 > 0 THEN floor(a2 / p2 * 1000 + 0.5) / 1000 END) AS quantity, p2 AS price, a2 AS amount FROM v""")
def fill_price_triple(spark: SparkSession, d: str) -> DataFrame:
    t = A.items(spark, d).selectExpr("invoice_id", "row_index", "spec_id", "CASE WHEN row_index % 3 <> 0 THEN quantity END AS q", "CASE WHEN row_index % 3 <> 1 THEN CAST(floor(price * 100 + 0.5) AS DOUBLE) / 100 END AS p", "CASE WHEN row_index % 3 <> 2 THEN amount END AS a")
    return t.withColumn("f", M.filled_triple(F.col("q"), F.col("p"), F.col("a"))).select("invoice_id", "row_index", "spec_id", "f.*")


@query("items invoices suppliers", f"""
SELECT project_id, CAST(count(*) AS BIGINT) AS lines, sum(CAST(floor(coalesce({_LINE}, price * quantity, 0) * 100 + 0.5) AS BIGINT)) / 100.0 AS delivery_total FROM items JOIN invoices USING (invoice_id) JOIN suppliers USING (supplier_id) WHERE is_delivery = 1 GROUP BY project_id""")
def delivery_total(spark: SparkSession, d: str) -> DataFrame:
    t = A.items(spark, d).where("is_delivery = 1").join(A.invoices(spark, d), "invoice_id").join(A.suppliers(spark, d), "supplier_id")
    return t.groupBy("project_id").agg(F.count("*").alias("lines"), (F.sum(_cents(F.coalesce(F.expr(_LINE), F.expr("price * quantity"), F.lit(0.0)))) / 100).alias("delivery_total"))


_SUMS = f", sums AS (SELECT invoice_id, sum(CAST(floor({_LINE} * 100 + 0.5) AS BIGINT)) / 100.0 AS line_total, CAST(count(*) AS BIGINT) AS n FROM items JOIN suppliers USING (supplier_id) WHERE is_delivery = 0 AND amount > 0 GROUP BY invoice_id)"


def _sums(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).where("is_delivery = 0 AND amount > 0").join(A.suppliers(spark, d), "supplier_id").groupBy("invoice_id").agg((F.sum(_cents(F.expr(_LINE))) / 100).alias("line_total"), F.count("*").alias("n"))


@query("items invoices suppliers", _SUMS + " SELECT invoice_id, total, line_total, abs(line_total - total) / total > 0.15 AS needs_review FROM sums JOIN invoices USING (invoice_id) WHERE total > 0")
def amount_review_flag(spark: SparkSession, d: str) -> DataFrame:
    return _sums(spark, d).join(A.invoices(spark, d).where("total > 0"), "invoice_id").select("invoice_id", "total", "line_total", F.expr("abs(line_total - total) / total > 0.15").alias("needs_review"))


@query("items invoices suppliers", _SUMS + " SELECT invoice_id, total / line_total AS factor FROM sums JOIN invoices USING (invoice_id) WHERE total > 0 AND total < line_total AND (line_total - total) / total > 0.15")
def document_discount_factor(spark: SparkSession, d: str) -> DataFrame:
    return _sums(spark, d).join(A.invoices(spark, d), "invoice_id").where("total > 0 AND total < line_total AND (line_total - total) / total > 0.15").select("invoice_id", F.expr("total / line_total").alias("factor"))


@query("items", " SELECT invoice_id, row_index, spec_id, floor(price * (1 - l_discount) * 100 + 0.5) / 100 AS price, floor(amount * (1 - l_discount) * 100 + 0.5) / 100 AS amount FROM items")
def apply_percent_discount(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("invoice_id", "row_index", "spec_id", M.cents(F.expr("price * (1 - l_discount)")).alias("price"), M.cents(F.expr("amount * (1 - l_discount)")).alias("amount"))


@query("items", " SELECT invoice_id, row_index, spec_id, price / (1 + row_index) AS price, price AS original_price, 'm' AS unit, 'pack' AS original_unit FROM items WHERE row_index <= 3")
def unit_conversion(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).where("row_index <= 3").select("invoice_id", "row_index", "spec_id", F.expr("price / (1 + row_index)").alias("price"), F.col("price").alias("original_price"), F.lit("m").alias("unit"), F.lit("pack").alias("original_unit"))


@query("items", " SELECT invoice_id, row_index, spec_id, amount / nullif(row_index - 1, 0) AS price FROM items")
def price_formula(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("invoice_id", "row_index", "spec_id", F.try_divide(F.col("amount"), F.col("row_index") - 1).alias("price"))


# --- roll-ups --------------------------------------------------------------

_LINES = ", lines AS (SELECT coalesce(nullif(section, ''), 'none') AS section, s.spec_id, s.quantity AS q, b.unit_price, b.analog FROM specs s LEFT JOIN best b USING (spec_id))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    s = A.specs(spark, d).select("spec_id", F.coalesce(F.nullif("section", F.lit("")), F.lit("none")).alias("section"), F.col("quantity").alias("q"), "name")
    return s.join(selected(spark, d).select("spec_id", "unit_price", "analog", "supplier_id"), "spec_id", "left")


@query("specs matched suppliers", _PRICED + _BEST + _LINES + """
 SELECT section, CAST(count(*) AS BIGINT) AS items, CAST(count(unit_price) AS BIGINT) AS matched, sum(CAST(floor(coalesce(unit_price * q, 0) * 100 + 0.5) AS BIGINT)) / 100.0 AS subtotal,
 sum(CAST(floor(CASE WHEN analog = 0 THEN unit_price * q ELSE 0 END * 100 + 0.5) AS BIGINT)) / 100.0 AS original_total, sum(CAST(floor(CASE WHEN analog = 1 THEN unit_price * q ELSE 0 END * 100 + 0.5) AS BIGINT)) / 100.0 AS analog_total FROM lines GROUP BY section""")
def project_summary_by_section(spark: SparkSession, d: str) -> DataFrame:
    total = lambda x: F.sum(_cents(x)) / 100
    return _lines(spark, d).groupBy("section").agg(F.count("*").alias("items"), F.count("unit_price").alias("matched"), total(F.coalesce(F.expr("unit_price * q"), F.lit(0.0))).alias("subtotal"), total(F.expr("CASE WHEN analog = 0 THEN unit_price * q ELSE 0 END")).alias("original_total"), total(F.expr("CASE WHEN analog = 1 THEN unit_price * q ELSE 0 END")).alias("analog_total"))


@query("specs matched suppliers", _PRICED + _BEST + _LINES + " SELECT coalesce(section, 'TOTAL') AS section, CAST(count(*) AS BIGINT) AS items, CAST(count(unit_price) AS BIGINT) AS matched, sum(CAST(floor(coalesce(unit_price * q, 0) * 100 + 0.5) AS BIGINT)) / 100.0 AS total FROM lines GROUP BY ROLLUP (section)")
def project_grand_total_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).rollup("section").agg(F.count("*").alias("items"), F.count("unit_price").alias("matched"), (F.sum(_cents(F.coalesce(F.expr("unit_price * q"), F.lit(0.0)))) / 100).alias("total"))
    return t.withColumn("section", F.coalesce("section", F.lit("TOTAL")))


def _export(mode: str) -> None:
    where = {"best": "is_delivery = 0", "original": "is_delivery = 0 AND analog = 0", "analog": "is_delivery = 0 AND analog = 1"}[mode]

    def run(spark: SparkSession, d: str) -> DataFrame:
        best = selected(spark, d, where).select("spec_id", "unit_price", "supplier_id")
        t = A.specs(spark, d).join(best, "spec_id", "left").select("section", "spec_id", "name", "quantity", "unit_price", M.cents(F.expr("unit_price * quantity")).alias("line_total"))
        return t.withColumn("row_no", pick([F.col("spec_id")], "section").cast("long"))

    run.__name__ = f"export_lines_{mode}"
    query("specs matched suppliers", _PRICED + _BEST.replace("is_delivery = 0", where) + " SELECT section, s.spec_id, name, s.quantity, unit_price, floor(unit_price * s.quantity * 100 + 0.5) / 100 AS line_total, row_number() OVER (PARTITION BY section ORDER BY s.spec_id) AS row_no FROM specs s LEFT JOIN best b USING (spec_id)")(run)


for _mode in ("best", "original", "analog"):
    _export(_mode)


# --- joins and sets --------------------------------------------------------


@query("items specs", """
 SELECT 'invoice' AS source, spec_id, invoice_id AS list_id, quantity, amount, price FROM items WHERE is_delivery = 0 UNION ALL SELECT 'price_list', spec_id, NULL, NULL, NULL, list_price FROM specs""")
def offers_union(spark: SparkSession, d: str) -> DataFrame:
    a = A.items(spark, d).where("is_delivery = 0").select(F.lit("invoice").alias("source"), "spec_id", F.col("invoice_id").alias("list_id"), "quantity", "amount", "price")
    return a.unionByName(A.specs(spark, d).selectExpr("'price_list' AS source", "spec_id", "CAST(NULL AS BIGINT) AS list_id", "CAST(NULL AS DOUBLE) AS quantity", "CAST(NULL AS DOUBLE) AS amount", "list_price AS price"))


@query("items invoices suppliers", " SELECT DISTINCT project_id, supplier_id, supplier FROM items JOIN invoices USING (invoice_id) JOIN suppliers USING (supplier_id)")
def project_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).select("invoice_id", "supplier_id").join(A.invoices(spark, d).select("invoice_id", "project_id"), "invoice_id").select("project_id", "supplier_id").distinct().join(A.suppliers(spark, d).select("supplier_id", "supplier"), "supplier_id")


@query("items matched", " SELECT invoice_id, row_index, spec_id, amount FROM items i WHERE is_delivery = 0 AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.spec_id = i.spec_id AND m.confirmed = 1 AND m.score >= 94)")
def unmatched_offers_anti(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).where("is_delivery = 0").join(A.matched(spark, d).where("confirmed = 1 AND score >= 94").select("spec_id"), "spec_id", "left_anti").select("invoice_id", "row_index", "spec_id", "amount")


@query("specs matched", " SELECT spec_id, name FROM specs s WHERE EXISTS (SELECT 1 FROM matched m WHERE m.spec_id = s.spec_id AND confirmed = 1 AND analog = 0)")
def confirmed_specs_semi(spark: SparkSession, d: str) -> DataFrame:
    return A.specs(spark, d).join(A.matched(spark, d).where("confirmed = 1 AND analog = 0"), "spec_id", "left_semi").select("spec_id", "name")


@query("specs matched", " SELECT spec_id FROM specs WHERE spec_id NOT IN (SELECT spec_id FROM matched WHERE confirmed = 1 AND score >= 90)")
def incremental_match_scope(spark: SparkSession, d: str) -> DataFrame:
    return A.specs(spark, d).select("spec_id").join(A.matched(spark, d).where("confirmed = 1 AND score >= 90"), "spec_id", "left_anti")


@query("invoices items", " SELECT invoice_id, (SELECT count(*) FROM items i WHERE i.invoice_id = v.invoice_id) AS item_count FROM invoices v")
def invoice_item_counts(spark: SparkSession, d: str) -> DataFrame:
    n = A.items(spark, d).groupBy("invoice_id").agg(F.count("*").alias("n"))
    return A.invoices(spark, d).join(n, "invoice_id", "left").select("invoice_id", F.coalesce("n", F.lit(0)).cast("long").alias("item_count"))


@query("matched invoices suppliers specs", """
 SELECT m.spec_id, m.row_index, m.invoice_id, m.source, coalesce(CASE WHEN source = 'invoice' THEN s.supplier END, 'list ' || p.code) AS offered_by, m.amount FROM matched m LEFT JOIN suppliers s ON source = 'invoice' AND s.supplier_id = m.supplier_id LEFT JOIN specs p ON source = 'price_list' AND p.spec_id = m.spec_id""")
def tagged_offer_join(spark: SparkSession, d: str) -> DataFrame:
    m = A.matched(spark, d)
    a = m.where("source = 'invoice'").join(A.suppliers(spark, d), "supplier_id", "left").select("spec_id", "row_index", "invoice_id", "source", F.col("supplier").alias("offered_by"), "amount")
    b = m.where("source = 'price_list'").join(A.specs(spark, d).select("spec_id", F.concat(F.lit("list "), "code").alias("offered_by")), "spec_id", "left").select("spec_id", "row_index", "invoice_id", "source", "offered_by", "amount")
    return a.unionByName(b)


# --- aggregates ------------------------------------------------------------


@query("specs matched", " SELECT CAST(count(DISTINCT s.spec_id) AS BIGINT) AS specs, CAST(count(DISTINCT m.spec_id) AS BIGINT) AS matched, CAST(count(DISTINCT CASE WHEN confirmed = 1 THEN m.spec_id END) AS BIGINT) AS confirmed FROM specs s LEFT JOIN matched m USING (spec_id)")
def coverage_stats(spark: SparkSession, d: str) -> DataFrame:
    m = A.matched(spark, d).groupBy("spec_id").agg(F.max("confirmed").alias("confirmed"))
    return A.specs(spark, d).select("spec_id").distinct().join(m, "spec_id", "left").agg(F.count("*").alias("specs"), F.count("confirmed").alias("matched"), F.count(F.when(F.col("confirmed") == 1, 1)).alias("confirmed"))


_TIER = "CASE WHEN score >= 95 THEN 'exact_article' WHEN score >= 85 THEN 'learned_rule' WHEN score >= 75 THEN 'name_similarity' ELSE 'name_characteristics' END"


@query("matched", f" SELECT {_TIER} AS match_type, CAST(count(DISTINCT spec_id) AS BIGINT) AS specs FROM matched GROUP BY 1")
def tier_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.matched(spark, d).select(F.expr(_TIER).alias("match_type"), "spec_id").distinct().groupBy("match_type").agg(F.count("*").alias("specs"))


@query("matched invoices", f" SELECT coalesce(CAST(project_id AS VARCHAR), 'all') AS project, coalesce({_TIER}, 'any') AS match_type, CAST(count(*) AS BIGINT) AS links FROM matched JOIN invoices USING (invoice_id) GROUP BY ROLLUP (project_id, {_TIER})")
def match_type_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = A.matched(spark, d).join(A.invoices(spark, d), "invoice_id").withColumn("t", F.expr(_TIER)).rollup("project_id", "t").agg(F.count("*").alias("links"))
    return t.select(F.coalesce(F.col("project_id").cast("string"), F.lit("all")).alias("project"), F.coalesce("t", F.lit("any")).alias("match_type"), "links")


@query("matched invoices", " SELECT project_id, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT spec_id) AS BIGINT) AS specs, CAST(sum(confirmed) AS BIGINT) AS confirmed, floor(sum(confirmed) * 1000.0 / count(*) + 0.5) / 10 AS confirmed_percent FROM matched JOIN invoices USING (invoice_id) GROUP BY project_id")
def baseline_by_project(spark: SparkSession, d: str) -> DataFrame:
    t = A.matched(spark, d).join(A.invoices(spark, d), "invoice_id").groupBy("project_id").agg(F.count("*").alias("links"), F.countDistinct("spec_id").alias("specs"), F.sum("confirmed").cast("long").alias("confirmed"))
    return t.withColumn("confirmed_percent", F.floor(F.expr("CAST(confirmed * 1000.0 AS DOUBLE) / links + 0.5")).cast("double") / 10)


@query("", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (value >= 20) AS BIGINT) AS open FROM events GROUP BY event_type")
def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") >= 20, 1)).alias("open"))


@query("", "SELECT user_id AS supplier, CAST(count(*) AS BIGINT) AS errors, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS hard FROM events GROUP BY user_id ORDER BY errors DESC, supplier LIMIT 10")
def feedback_top_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").groupBy(F.col("user_id").alias("supplier")).agg(F.count("*").alias("errors"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).cast("long").alias("hard")).orderBy(F.desc("errors"), "supplier").limit(10)


# --- rules -----------------------------------------------------------------

_RULES = ", rules AS (SELECT spec_id * 1000 + supplier_id AS rule_key, p.p_name AS spec_pattern, p.code AS offer_pattern, CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE supplier_id END AS scope, score, invoice_id AS used_at, row_index, amount, CASE WHEN score < 60 THEN 1 ELSE 0 END AS is_negative, analog FROM matched JOIN specs p USING (spec_id))"


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return A.matched(spark, d).join(A.specs(spark, d).select("spec_id", F.col("p_name").alias("spec_pattern"), F.col("code").alias("offer_pattern")), "spec_id").selectExpr("spec_id * 1000 + supplier_id AS rule_key", "spec_pattern", "offer_pattern", "CASE WHEN supplier_id % 3 = 0 THEN NULL ELSE supplier_id END AS scope", "score", "invoice_id AS used_at", "row_index", "amount", "CASE WHEN score < 60 THEN 1 ELSE 0 END AS is_negative", "analog")


_KEY = ("spec_pattern", "offer_pattern", "scope0")


@query("matched specs", _RULES + " SELECT spec_pattern, offer_pattern, coalesce(scope, -1) AS scope0, rule_key, used_at FROM (SELECT *, row_number() OVER (PARTITION BY spec_pattern, offer_pattern, coalesce(scope, -1) ORDER BY used_at DESC, rule_key DESC, row_index DESC, amount DESC) AS rn FROM rules) WHERE rn = 1")
def rule_dedupe_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    t = _rules(spark, d).withColumn("scope0", F.coalesce("scope", F.lit(-1)).cast("long"))
    return t.withColumn("rn", pick([F.desc(c) for c in ("used_at", "rule_key", "row_index", "amount")], *_KEY)).where("rn = 1").select(*_KEY, "rule_key", "used_at")


@query("matched specs", _RULES + " SELECT spec_pattern, offer_pattern, coalesce(scope, -1) AS scope0, CAST(count(*) AS BIGINT) AS times_used, least(97, max(score)) AS confidence FROM rules GROUP BY ALL HAVING count(*) > 1")
def rule_usage_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).withColumn("scope0", F.coalesce("scope", F.lit(-1)).cast("long")).groupBy(*_KEY).agg(F.count("*").alias("times_used"), F.least(F.lit(97), F.max("score")).alias("confidence")).where("times_used > 1")


_DISTINCT = _RULES + ", r AS (SELECT spec_pattern, offer_pattern, scope, max(is_negative) AS is_negative, max(analog) AS analog FROM rules GROUP BY ALL)"


@query("matched specs", _DISTINCT + """
 SELECT a.spec_pattern, a.scope, a.offer_pattern AS left_offer, b.offer_pattern AS right_offer, CASE WHEN a.is_negative <> b.is_negative THEN 'sign' WHEN a.analog <> b.analog THEN 'analog' ELSE 'duplicate' END AS conflict FROM r a JOIN r b ON a.spec_pattern = b.spec_pattern AND a.scope IS NOT DISTINCT FROM b.scope AND a.offer_pattern < b.offer_pattern""")
def rule_conflicts(spark: SparkSession, d: str) -> DataFrame:
    r = _rules(spark, d).groupBy("spec_pattern", "offer_pattern", "scope").agg(F.max("is_negative").alias("neg"), F.max("analog").alias("ana"))
    a, b = r.alias("a"), r.alias("b")
    t = a.join(b, (F.col("a.spec_pattern") == F.col("b.spec_pattern")) & F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.offer_pattern") < F.col("b.offer_pattern")))
    kind = F.when(F.expr("a.neg <> b.neg"), "sign").when(F.expr("a.ana <> b.ana"), "analog").otherwise("duplicate")
    return t.select("a.spec_pattern", "a.scope", F.col("a.offer_pattern").alias("left_offer"), F.col("b.offer_pattern").alias("right_offer"), kind.alias("conflict"))


@query("matched specs", _RULES + """
, old AS (SELECT spec_pattern, offer_pattern, max(score) AS c FROM rules WHERE used_at % 2 = 0 GROUP BY ALL), new AS (SELECT spec_pattern, offer_pattern, max(score) AS c FROM rules WHERE used_at % 2 = 1 GROUP BY ALL)
 SELECT spec_pattern, offer_pattern, CASE WHEN old.c IS NULL THEN new.c WHEN new.c IS NULL THEN old.c WHEN new.c > old.c THEN new.c ELSE least(97, old.c + 2) END AS confidence FROM old FULL JOIN new USING (spec_pattern, offer_pattern)""")
def rule_upsert_positive(spark: SparkSession, d: str) -> DataFrame:
    half = lambda k, name: _rules(spark, d).where(f"used_at % 2 = {k}").groupBy("spec_pattern", "offer_pattern").agg(F.max("score").alias(name))
    c = F.expr("CASE WHEN old IS NULL THEN new WHEN new IS NULL THEN old WHEN new > old THEN new ELSE least(97, old + 2) END")
    return half(0, "old").join(half(1, "new"), ["spec_pattern", "offer_pattern"], "full").select("spec_pattern", "offer_pattern", c.alias("confidence"))


@query("matched specs", _DISTINCT + " SELECT spec_pattern, offer_pattern, scope, analog FROM r WHERE is_negative = 0")
def rule_rollback(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).groupBy("spec_pattern", "offer_pattern", "scope").agg(F.max("is_negative").alias("neg"), F.max("analog").alias("analog")).where("neg = 0").drop("neg")


# --- ranks and duplicate groups --------------------------------------------

_RANK = " SELECT spec_id, supplier_id, invoice_id, row_index, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY spec_id ORDER BY score DESC, supplier_id, invoice_id, row_index, quantity, amount) AS rn FROM matched) WHERE "


def _ranked(spark: SparkSession, d: str, where: str) -> DataFrame:
    return A.matched(spark, d).withColumn("rn", pick(_ORDER(), "spec_id").cast("long")).where(where).select("spec_id", "supplier_id", "invoice_id", "row_index", "score", "rn")


@query("matched", _RANK + "rn <= 8")
def top8_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "rn <= 8")


@query("matched", _RANK + "rn = 1")
def selected_candidate(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "rn = 1")


@query("matched", _RANK + "rn BETWEEN 2 AND 3 AND score >= 50")
def alternatives_top2(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, "rn BETWEEN 2 AND 3 AND score >= 50")


@query("specs", " SELECT spec_id, name, CAST(count(*) OVER w AS BIGINT) AS size, min(spec_id) OVER w AS leader, CASE WHEN spec_id = min(spec_id) OVER w THEN 'leader' ELSE 'follower' END AS role FROM specs WINDOW w AS (PARTITION BY name) QUALIFY size >= 2")
def dup_groups(spark: SparkSession, d: str) -> DataFrame:
    s = A.specs(spark, d).select("spec_id", "name", T.normalized(F.col("name")).alias("key"))
    g = s.groupBy("key").agg(F.count("*").alias("size"), F.min("spec_id").alias("leader")).where("size >= 2")
    return s.join(g, "key").select("spec_id", "name", "size", "leader", F.when(F.expr("spec_id = leader"), "leader").otherwise("follower").alias("role"))


# --- time series -----------------------------------------------------------


@query("", "SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def metrics_history_latest_n(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").withColumn("rn", pick([F.desc("ts"), F.desc("event_id")], "user_id")).where("rn <= 5").select("user_id", "event_id", "ts", "value")


@query("", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_project(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")


@query("", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(count(*) AS BIGINT) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) / 100.0 AS total FROM events GROUP BY ALL")
def daily_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), (F.sum(_cents(F.col("value"))) / 100).alias("total"))


@query("", """
WITH v AS (SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events), d AS (SELECT *, c - lag(c, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM v),
days AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, sum(delta) AS delta FROM d GROUP BY 1)
SELECT day, sum(delta) OVER (ORDER BY day) / 100.0 AS readiness FROM days""")
def portfolio_readiness_running(spark: SparkSession, d: str) -> DataFrame:
    v = A.read(spark, d, "events").withColumn("c", _cents(F.col("value")))
    delta = F.col("c") - F.lag("c", 1, 0).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    days = v.withColumn("delta", delta).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.sum("delta").alias("delta"))  # a row a day
    return days.select("day", (F.sum("delta").over(Window.orderBy("day")) / 100).alias("readiness"))


# --- text, features, similarity --------------------------------------------


@query("specs", " SELECT spec_id, regexp_replace(lower(p_name), '\\s+', ' ', 'g') || ' dn ' || p_size AS normalized, p_size AS dn, lower(p_name) AS head FROM specs")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return A.specs(spark, d).select("spec_id", T.normalized(F.col("name")).alias("normalized"), T.diameter(F.col("name")).alias("dn"), T.entity_head(F.col("name")).alias("head"))


@query("specs matched", " SELECT m.spec_id, m.invoice_id, m.row_index, m.quantity, CASE WHEN abs(s.quantity - m.quantity) < 0.0001 THEN 1 WHEN abs(s.quantity - m.quantity) / greatest(s.quantity, m.quantity) <= 0.05 THEN 0 ELSE -1 END AS score FROM matched m JOIN specs s USING (spec_id) WHERE s.quantity > 0 AND m.quantity > 0")
def quantity_score(spark: SparkSession, d: str) -> DataFrame:
    m = A.matched(spark, d).where("quantity > 0").withColumnRenamed("quantity", "q")
    return m.join(A.specs(spark, d).where("quantity > 0").select("spec_id", "quantity"), "spec_id").select("spec_id", "invoice_id", "row_index", F.col("q").alias("quantity"), T.quantity_score(F.col("quantity"), F.col("q")).alias("score"))


@query("specs", """
, n AS (SELECT DISTINCT p_name AS name, replace(p_name, ' ', '') AS t FROM specs), g AS (SELECT name, substr(t, i, 2) AS gram, count(*) AS c, any_value(length(t)) AS l FROM n, unnest(range(1, length(t))) u(i) GROUP BY 1, 2)
 SELECT a.name AS left_name, b.name AS right_name, floor(2.0 * sum(least(a.c, b.c)) / (a.l + b.l - 2) * 1000 + 0.5) / 1000 AS dice FROM g a JOIN g b USING (gram) GROUP BY a.name, b.name, a.l, b.l HAVING 2.0 * sum(least(a.c, b.c)) / (a.l + b.l - 2) >= 0.6""")
def dice_self_join(spark: SparkSession, d: str) -> DataFrame:
    n = A.specs(spark, d).select("p_name").distinct().select(F.col("p_name").alias("id"), F.col("p_name").alias("name"))
    return dice_join(n, n, 0.6).select(F.col("a").alias("left_name"), F.col("b").alias("right_name"), (F.floor(F.col("dice") * 1000 + 0.5) / 1000).alias("dice"))


@query("specs", """
, n AS (SELECT DISTINCT p_name AS name FROM specs) SELECT a.name AS left_name, b.name AS right_name, CAST(levenshtein(a.name, b.name) AS INT) AS distance FROM n a JOIN n b ON split_part(a.name, ' ', 2) = split_part(b.name, ' ', 2)""")
def levenshtein_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = A.specs(spark, d).select(F.col("p_name").alias("name"), F.split("p_name", " ")[1].alias("head")).distinct()
    return n.alias("a").join(n.alias("b"), F.expr("a.head = b.head")).select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), F.levenshtein("a.name", "b.name").alias("distance"))


@query("", r"SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS BIGINT) AS letters, regexp_matches(text, '[0-9]{4}') AS has_number FROM documents")
def text_profile(spark: SparkSession, d: str) -> DataFrame:
    t = A.read(spark, d, "documents")
    return t.select("doc_id", F.length("text").cast("long").alias("n"), F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long").alias("letters"), F.col("text").rlike("[0-9]{4}").alias("has_number"))


@query("", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("", """
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent_turn,
 CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS island FROM conversations""")
def carry_forward_parent(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.col("role") == "user"
    return A.read(spark, d, "conversations").select("conv_id", "turn", "role", F.last(F.when(user, F.col("turn")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("parent_turn"), F.sum(F.when(user, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("island"))


@query("items invoices", """
, f AS (SELECT invoice_id, CAST(count(*) FILTER (abs(price * quantity - amount) > 0.01) AS BIGINT) AS bad_rows, CAST(count(*) FILTER (price <= 0) AS BIGINT) AS bad_prices, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS s FROM items GROUP BY invoice_id)
 SELECT invoice_id, bad_rows, bad_prices, abs(s - total) > 1 AS sum_differs, bad_rows + bad_prices = 0 AND abs(s - total) <= 1 AS valid FROM f JOIN invoices USING (invoice_id)""")
def validate_invoice_issues(spark: SparkSession, d: str) -> DataFrame:
    f = A.items(spark, d).groupBy("invoice_id").agg(F.count(F.when(F.expr("abs(price * quantity - amount) > 0.01"), 1)).alias("bad_rows"), F.count(F.when(F.expr("price <= 0"), 1)).alias("bad_prices"), (F.sum(_cents(F.col("amount"))) / 100).alias("s"))
    return f.join(A.invoices(spark, d), "invoice_id").selectExpr("invoice_id", "bad_rows", "bad_prices", "abs(s - total) > 1 AS sum_differs", "bad_rows + bad_prices = 0 AND abs(s - total) <= 1 AS valid")


@query("items", """
, w AS (SELECT invoice_id, spec_id % 4 AS width, count(*) AS n, min(row_index) AS first FROM items GROUP BY ALL), m AS (SELECT invoice_id, width FROM w QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY n DESC, first, width) = 1)
 SELECT invoice_id, CAST(m.width AS BIGINT) AS width, CAST(count(*) FILTER (abs(spec_id % 4 - m.width) <= 1) AS BIGINT) AS kept FROM items JOIN m USING (invoice_id) GROUP BY ALL""")
def dominant_width_filter(spark: SparkSession, d: str) -> DataFrame:
    t = A.items(spark, d).withColumn("w", F.expr("spec_id % 4"))
    n = t.groupBy("invoice_id", "w").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
    m = n.withColumn("rn", pick([F.desc("n"), F.col("first"), F.col("w")], "invoice_id")).where("rn = 1").select("invoice_id", F.col("w").alias("width"))
    return t.join(m, "invoice_id").groupBy("invoice_id", "width").agg(F.count(F.when(F.expr("abs(w - width) <= 1"), 1)).alias("kept"))


@query("matched", " SELECT invoice_id, CAST(max(row_index) + 1 AS INT) AS next_version, CAST(count(*) AS BIGINT) AS rows FROM matched GROUP BY invoice_id")
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    return A.matched(spark, d).groupBy("invoice_id").agg((F.max("row_index") + 1).cast("int").alias("next_version"), F.count("*").alias("rows"))


@query("matched", " SELECT invoice_id, spec_id, row_index, amount FROM matched")
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    """Rows packed into one JSON snapshot an invoice, and restored from it."""
    packed = A.matched(spark, d).groupBy("invoice_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("spec_id", "row_index", "amount", "quantity", "supplier_id")))).alias("snapshot"))
    rows = packed.select("invoice_id", F.inline(F.from_json("snapshot", "array<struct<spec_id:bigint,row_index:int,amount:double,quantity:double,supplier_id:bigint>>")))
    return rows.select("invoice_id", "spec_id", "row_index", "amount")


@query("specs matched", """
, a AS (SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY invoice_id, row_index, supplier_id, amount) AS pos, amount FROM matched WHERE source = 'invoice'), b AS (SELECT spec_id, row_number() OVER (PARTITION BY spec_id ORDER BY invoice_id, row_index, supplier_id, amount) AS pos, amount FROM matched WHERE source = 'price_list')
 SELECT spec_id, pos, a.amount AS expected, b.amount AS actual, CASE WHEN b.amount IS NULL THEN 'MISSING' WHEN a.amount IS NULL THEN 'EXTRA' WHEN abs(a.amount - b.amount) <= 0.01 THEN 'OK' WHEN abs(a.amount - b.amount) / a.amount <= 0.05 THEN 'WARN' ELSE 'FAIL' END AS status FROM a FULL JOIN b USING (spec_id, pos)""")
def row_pairs_full_outer(spark: SparkSession, d: str) -> DataFrame:
    def side(source: str, name: str) -> DataFrame:
        return A.matched(spark, d).where(F.col("source") == source).select("spec_id", pick([F.col(c) for c in ("invoice_id", "row_index", "supplier_id", "amount")], "spec_id").cast("long").alias("pos"), F.col("amount").alias(name))

    t = side("invoice", "expected").join(side("price_list", "actual"), ["spec_id", "pos"], "full")
    status = F.expr("CASE WHEN actual IS NULL THEN 'MISSING' WHEN expected IS NULL THEN 'EXTRA' WHEN abs(expected - actual) <= 0.01 THEN 'OK' WHEN abs(expected - actual) / expected <= 0.05 THEN 'WARN' ELSE 'FAIL' END")
    return t.select("spec_id", "pos", "expected", "actual", status.alias("status"))
