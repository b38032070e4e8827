"""Tax once, overrides, discounts and document checks as queries, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import money as M
from larkspan.functions import names as N
from larkspan.plans.registry import query
from larkspan.sources import adapters as A

_R = "floor(({0}) * 100 + 0.5) / 100"


def _convert(v: str, column: str, rate: str, supplier: str) -> str:
    up, down = _R.format(f"{v} * (1 + {rate} / 100)"), _R.format(f"{v} / (1 + {rate} / 100)")
    return f"CASE WHEN {rate} > 0 AND {column} = true AND {supplier} = 0 THEN {down} WHEN {rate} > 0 AND {column} = false AND {supplier} = 1 THEN {up} ELSE {v} END"


def _mismatch(column: str, supplier: str) -> str:
    return f"coalesce(({column} = true AND {supplier} = 0) OR ({column} = false AND {supplier} = 1), false)"


_STATES = ("CASE row_index % 3 WHEN 0 THEN true WHEN 1 THEN false END", "CASE (row_index + supplier_id) % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_TAXED = f", t AS (SELECT i.*, incl, rate, {_STATES[0]} AS amount_state, {_STATES[1]} AS price_state FROM items i JOIN suppliers USING (supplier_id))"


def _states(spark: SparkSession, d: str) -> DataFrame:
    t = A.items(spark, d).join(A.suppliers(spark, d).drop("supplier"), "supplier_id")
    return t.withColumns({"amount_state": F.expr(_STATES[0]), "price_state": F.expr(_STATES[1])})


@query("items suppliers", _TAXED + f""" SELECT invoice_id, row_index, spec_id, quantity, {_convert('price', 'price_state', 'rate', 'incl')} AS price, {_convert('amount', 'amount_state', 'rate', 'incl')} AS amount, {_mismatch('amount_state', 'incl')} OR {_mismatch('price_state', 'incl')} AS needs_review,
 nullif(concat_ws('; ', CASE WHEN {_mismatch('amount_state', 'incl')} THEN 'amount column' END, CASE WHEN {_mismatch('price_state', 'incl')} THEN 'price column' END, CASE WHEN ({_mismatch('amount_state', 'incl')} OR {_mismatch('price_state', 'incl')}) AND NOT rate > 0 THEN 'no usable rate' END), '') AS reasons FROM t""")
def vat_exactly_once_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parsed rows brought to the tax semantics that the supplier's flag stands for; a mismatch without a rate changes nothing and is marked."""
    a, p = M.vat_mismatch(F.col("amount_state"), F.col("incl")), M.vat_mismatch(F.col("price_state"), F.col("incl"))
    reasons = F.concat_ws("; ", F.when(a, "amount column"), F.when(p, "price column"), F.when((a | p) & ~F.coalesce(F.col("rate") > 0, F.lit(False)), "no usable rate"))
    convert = lambda c, s: M.convert_vat(F.col(c), F.col(s), F.col("rate"), F.col("incl")).alias(c)
    return _states(spark, d).select("invoice_id", "row_index", "spec_id", "quantity", convert("price", "price_state"), convert("amount", "amount_state"), (a | p).alias("needs_review"), F.nullif(reasons, F.lit("")).alias("reasons"))


_MODEL = "CASE WHEN row_index % 5 = 0 THEN 10.0 END"


@query("items suppliers", _TAXED + f""", m AS (SELECT *, coalesce({_MODEL}, rate) AS r FROM t) SELECT invoice_id, row_index, spec_id, quantity, {_convert('price', 'amount_state', 'r', 'incl')} AS price, {_convert('amount', 'amount_state', 'r', 'incl')} AS amount, {_mismatch('amount_state', 'incl')} AS needs_review FROM m""")
def model_rows_vat_once(spark: SparkSession, d: str) -> DataFrame:
    """The same for rows that a model has read: one state and, where it names one, a rate of the document."""
    t = _states(spark, d).withColumn("r", F.coalesce(F.expr(_MODEL).cast("double"), F.col("rate")))
    convert = lambda c: M.convert_vat(F.col(c), F.col("amount_state"), F.col("r"), F.col("incl")).alias(c)
    return t.select("invoice_id", "row_index", "spec_id", "quantity", convert("price"), convert("amount"), M.vat_mismatch(F.col("amount_state"), F.col("incl")).alias("needs_review"))


_SECOND = ("CASE WHEN row_index % 4 = 0 THEN NULL ELSE price END", "CASE WHEN row_index % 4 = 1 THEN NULL WHEN row_index % 4 = 2 THEN amount * 1.05 ELSE amount END")


@query("items suppliers", _TAXED + f""", o AS (SELECT *, {_SECOND[0]} AS p, {_SECOND[1]} AS a FROM t), f AS (SELECT *, coalesce(p, CASE WHEN quantity > 0 THEN {_R.format('a / quantity')} END) AS p2, coalesce(a, CASE WHEN quantity > 0 THEN {_R.format('p * quantity')} END) AS a2 FROM o)
 SELECT invoice_id, row_index, spec_id, quantity, {_convert('p2', 'amount_state', 'rate', 'incl')} AS price, {_convert('a2', 'amount_state', 'rate', 'incl')} AS amount FROM f WHERE p2 IS NOT NULL AND a2 IS NOT NULL AND NOT (quantity > 0 AND abs(p2 * quantity - a2) > greatest(1.0, abs(a2) * 0.02))""")
def financial_override(spark: SparkSession, d: str) -> DataFrame:
    """Prices and amounts of a second reading that fill each other and agree within 2 % or one unit of money."""
    t = _states(spark, d).withColumns({"p": F.expr(_SECOND[0]), "a": F.expr(_SECOND[1])})
    t = t.withColumns({"p2": F.coalesce("p", F.when(F.col("quantity") > 0, M.cents(F.try_divide("a", "quantity")))), "a2": F.coalesce("a", F.when(F.col("quantity") > 0, M.cents(F.col("p") * F.col("quantity"))))})
    wrong = F.expr("quantity > 0 AND abs(p2 * quantity - a2) > greatest(1.0D, abs(a2) * 0.02)")
    convert = lambda c, n: M.convert_vat(F.col(c), F.col("amount_state"), F.col("rate"), F.col("incl")).alias(n)
    return t.where("p2 IS NOT NULL AND a2 IS NOT NULL").where(~wrong).select("invoice_id", "row_index", "spec_id", "quantity", convert("p2", "price"), convert("a2", "amount"))


@query("named", """, p AS (SELECT a.spec_id, b.spec_id AS other_id, a.quantity AS q1, b.quantity AS q2, lower(regexp_replace(trim(coalesce(a.unit, '')), '[.\\s]+', '', 'g')) AS u1, lower(regexp_replace(trim(coalesce(b.unit, '')), '[.\\s]+', '', 'g')) AS u2 FROM named a JOIN named b ON b.spec_id = a.spec_id + 1)
 SELECT spec_id, other_id, coalesce(abs(q1 - q2) <= greatest(0.001, abs(q1) * 0.001), false) AS same_quantity, coalesce(NOT abs(q1 - q2) <= greatest(0.001, abs(q1) * 0.001), false) AS quantity_conflict, u1 <> '' AND u1 = u2 AS same_unit, u1 <> '' AND u2 <> '' AND u1 <> u2 AS unit_conflict FROM p""")
def quantity_unit_conflicts(spark: SparkSession, d: str) -> DataFrame:
    a = A.named(spark, d).select("spec_id", F.col("quantity").alias("q1"), N.unit_key(F.col("unit")).alias("u1"))
    b = A.named(spark, d).select(F.col("spec_id").alias("other_id"), (F.col("spec_id") - 1).alias("spec_id"), F.col("quantity").alias("q2"), N.unit_key(F.col("unit")).alias("u2"))
    same = F.expr("abs(q1 - q2) <= greatest(0.001D, abs(q1) * 0.001)")
    no = F.lit(False)
    return a.join(b, "spec_id").select("spec_id", "other_id", F.coalesce(same, no).alias("same_quantity"), F.coalesce(~same, no).alias("quantity_conflict"), F.expr("u1 <> '' AND u1 = u2").alias("same_unit"), F.expr("u1 <> '' AND u2 <> '' AND u1 <> u2").alias("unit_conflict"))


_GOODS = """, g AS (SELECT i.invoice_id, CASE WHEN incl = 0 AND rate > 0 THEN amount * (1 + rate / 100) ELSE amount END AS a FROM items i JOIN suppliers USING (supplier_id) WHERE is_delivery = 0 AND amount > 0),
 s AS (SELECT invoice_id, sum(CAST(floor(a * 100 + 0.5) AS BIGINT)) / 100.0 AS line_total FROM g GROUP BY invoice_id), f AS (SELECT invoice_id, total / line_total AS factor FROM s JOIN invoices USING (invoice_id) WHERE total > 0 AND total < line_total AND (line_total - total) / total > 0.15),
 c AS (SELECT invoice_id, factor, avg(CASE WHEN abs(a * factor - floor(a * factor * 100 + 0.5) / 100) / CASE WHEN floor(a * factor * 100 + 0.5) = 0 THEN 1 ELSE floor(a * factor * 100 + 0.5) / 100 END <= 0.02 THEN 1.0 ELSE 0.0 END) AS consistent FROM g JOIN f USING (invoice_id) GROUP BY invoice_id, factor)"""


def _consistent_factors(spark: SparkSession, d: str) -> DataFrame:
    """(invoice_id, factor): documents whose goods cost over 15 % more than the total, nine tenths of the lines being consistent with one factor."""
    g = A.items(spark, d).where("is_delivery = 0 AND amount > 0").join(A.suppliers(spark, d), "supplier_id").select("invoice_id", F.expr("CASE WHEN incl = 0 AND rate > 0 THEN amount * (1 + rate / 100) ELSE amount END").alias("a"))
    totals = A.read(spark, d, "orders").selectExpr("o_orderkey AS invoice_id", "o_totalprice AS total")
    f = g.groupBy("invoice_id").agg((F.sum(F.floor(F.col("a") * 100 + 0.5)) / 100).alias("line_total")).join(totals, "invoice_id").where("total > 0 AND total < line_total AND (line_total - total) / total > 0.15").selectExpr("invoice_id", "total / line_total AS factor")
    scaled, rounded = F.col("a") * F.col("factor"), M.cents(F.col("a") * F.col("factor"))
    near = F.abs(scaled - rounded) / F.when(rounded == 0, 1.0).otherwise(rounded) <= 0.02
    return g.join(f, "invoice_id").groupBy("invoice_id", "factor").agg(F.avg(near.cast("double")).alias("consistent")).where("consistent >= 0.9").select("invoice_id", "factor")


@query("items invoices suppliers", _GOODS + f" SELECT i.invoice_id, row_index, spec_id, {_R.format('price * factor')} AS price, {_R.format('amount * factor')} AS amount FROM items i JOIN c USING (invoice_id) WHERE consistent >= 0.9 AND is_delivery = 0")
def apply_document_discount(spark: SparkSession, d: str) -> DataFrame:
    """Goods of documents with a hidden discount, at the discounted price; delivery lines keep theirs and are not returned."""
    t = A.items(spark, d).where("is_delivery = 0").join(_consistent_factors(spark, d), "invoice_id")
    return t.select("invoice_id", "row_index", "spec_id", M.cents(F.expr("price * factor")).alias("price"), M.cents(F.expr("amount * factor")).alias("amount"))


@query("items", " SELECT invoice_id, CAST(count(*) AS BIGINT) AS lines, floor(avg(CASE WHEN abs(price * quantity - amount) <= greatest(0.5, amount * 0.01) THEN 1.0 ELSE 0.0 END) * 1000 + 0.5) / 1000 AS consistent, array_to_string(list_sort(list(CAST(CAST(floor(price * 100 + 0.5) AS BIGINT) AS VARCHAR))), ' ') AS prices FROM items WHERE quantity > 0 GROUP BY invoice_id")
def price_consistency(spark: SparkSession, d: str) -> DataFrame:
    """The share of lines whose price times quantity is the amount, and the sorted prices in cents."""
    t = A.items(spark, d).where("quantity > 0")
    ok = F.expr("abs(price * quantity - amount) <= greatest(0.5D, amount * 0.01)").cast("double")
    g = t.groupBy("invoice_id").agg(F.count("*").alias("lines"), F.avg(ok).alias("x"), F.array_join(F.sort_array(F.collect_list(F.floor(F.col("price") * 100 + 0.5).cast("string"))), " ").alias("prices"))
    return g.select("invoice_id", "lines", (F.floor(F.col("x") * 1000 + 0.5) / 1000).alias("consistent"), "prices")


_RATES = "(0, 5, 7, 10, 18, 20, 22)"
_LIKE_RATES = "CASE WHEN invoice_id % 5 = 0 AND row_index <> 2 THEN 20.0 ELSE price END"


@query("items", f""", p AS (SELECT *, {_LIKE_RATES} AS shown FROM items), v AS (SELECT invoice_id, count(*) FILTER (shown IN {_RATES}) * 2 > count(shown) AS wrong FROM p GROUP BY invoice_id)
 SELECT p.invoice_id, row_index, spec_id, quantity, CASE WHEN NOT wrong THEN shown END AS price, CASE WHEN NOT wrong THEN amount END AS amount FROM p JOIN v USING (invoice_id)""")
def rates_read_as_prices(spark: SparkSession, d: str) -> DataFrame:
    """Documents over half of whose prices are tax rates lose prices and amounts."""
    p = A.items(spark, d).withColumn("shown", F.expr(_LIKE_RATES).cast("double"))
    v = p.groupBy("invoice_id").agg((F.count(F.when(F.expr(f"shown IN {_RATES}"), 1)) * 2 > F.count("shown")).alias("wrong"))
    return p.join(v, "invoice_id").select("invoice_id", "row_index", "spec_id", "quantity", F.expr("CASE WHEN NOT wrong THEN shown END").alias("price"), F.expr("CASE WHEN NOT wrong THEN amount END").alias("amount"))


@query("items invoices", """, s AS (SELECT invoice_id, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) / 100.0 AS summed FROM items GROUP BY invoice_id), t AS (SELECT invoice_id, CASE WHEN invoice_id % 4 = 0 THEN NULL ELSE total END AS total FROM invoices)
 SELECT invoice_id, coalesce(total, CASE WHEN summed > 0 THEN summed END) AS total, total IS NULL AND summed > 0 AS from_lines FROM t JOIN s USING (invoice_id)""")
def fallback_totals(spark: SparkSession, d: str) -> DataFrame:
    s = A.items(spark, d).groupBy("invoice_id").agg((F.sum(F.floor(F.col("amount") * 100 + 0.5)) / 100).alias("summed"))
    t = A.read(spark, d, "orders").selectExpr("o_orderkey AS invoice_id", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS total")
    return t.join(s, "invoice_id").select("invoice_id", F.coalesce("total", F.expr("CASE WHEN summed > 0 THEN summed END")).alias("total"), F.expr("total IS NULL AND summed > 0").alias("from_lines"))


@query("items", """, old AS (SELECT invoice_id, count(*) AS n, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) AS s FROM items WHERE invoice_id % 7 <> 0 GROUP BY invoice_id), new AS (SELECT invoice_id, count(*) AS n, sum(CAST(floor(amount * 100 + 0.5) AS BIGINT)) + CASE WHEN invoice_id % 5 = 0 THEN 300 ELSE 0 END AS s FROM items WHERE invoice_id % 11 <> 0 GROUP BY invoice_id)
 SELECT coalesce(old.invoice_id, new.invoice_id) AS invoice_id, CASE WHEN new.invoice_id IS NULL THEN 'GONE' WHEN old.invoice_id IS NULL THEN 'NEW' WHEN old.n = new.n AND abs(old.s - new.s) <= 1 THEN 'SAME' ELSE 'CHANGED' END AS verdict FROM old FULL JOIN new USING (invoice_id)""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a parser compared by document: rows and sums within a cent."""
    def side(k: int, extra: Column) -> DataFrame:
        return A.items(spark, d).where(f"invoice_id % {k} <> 0").groupBy("invoice_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("amount") * 100 + 0.5)).alias("s")).withColumn("s", F.col("s") + extra)

    old, new = side(7, F.lit(0)).alias("o"), side(11, F.expr("CASE WHEN invoice_id % 5 = 0 THEN 300 ELSE 0 END")).alias("n")
    verdict = F.when(F.col("n.n").isNull(), "GONE").when(F.col("o.n").isNull(), "NEW").when(F.expr("o.n = n.n AND abs(o.s - n.s) <= 1"), "SAME").otherwise("CHANGED")
    return old.join(new, F.col("o.invoice_id") == F.col("n.invoice_id"), "full").select(F.coalesce("o.invoice_id", "n.invoice_id").alias("invoice_id"), verdict.alias("verdict"))


@query("matched invoices suppliers", """, x AS (SELECT project_id, spec_id, m.supplier_id, quantity, amount, rate, incl, CASE WHEN incl = 0 AND rate > 0 THEN amount * (1 + rate / 100) ELSE amount END AS line FROM matched m JOIN invoices USING (invoice_id) JOIN suppliers s ON s.supplier_id = m.supplier_id WHERE is_delivery = 0)
 SELECT project_id, spec_id, CAST(count(DISTINCT supplier_id) AS BIGINT) AS suppliers, min(CAST(floor(line / nullif(quantity, 0) * 100 + 0.5) AS BIGINT)) / 100.0 AS cheapest, max(CAST(floor(line / nullif(quantity, 0) * 100 + 0.5) AS BIGINT)) / 100.0 AS dearest FROM x GROUP BY project_id, spec_id""")
def price_spread(spark: SparkSession, d: str) -> DataFrame:
    """What the suppliers of a project ask for an item, with tax."""
    t = A.matched(spark, d).where("is_delivery = 0").join(A.invoices(spark, d).select("invoice_id", "project_id"), "invoice_id").join(A.suppliers(spark, d), "supplier_id")
    price = F.floor(F.try_divide(F.expr("CASE WHEN incl = 0 AND rate > 0 THEN amount * (1 + rate / 100) ELSE amount END"), F.col("quantity")) * 100 + 0.5)
    return t.groupBy("project_id", "spec_id").agg(F.countDistinct("supplier_id").alias("suppliers"), (F.min(price) / 100).alias("cheapest"), (F.max(price) / 100).alias("dearest"))
