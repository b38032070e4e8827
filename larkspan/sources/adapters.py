"""Domain views over the star-schema tables: suppliers, invoices, lines, specifications, matches, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS supplier_id", "s_name AS supplier", "CAST(s_suppkey % 2 AS INT) AS incl", "CAST(element_at(array(0, 10, 20, 22), CAST((s_suppkey div 2) % 4 AS INT) + 1) AS DOUBLE) AS rate")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).selectExpr("o_orderkey AS invoice_id", "c_nationkey AS project_id", "o_totalprice AS total", "o_orderdate AS invoice_date", "o_orderstatus AS status")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS invoice_id", "l_suppkey AS supplier_id", "l_partkey AS spec_id", "l_linenumber AS row_index", "l_quantity AS quantity", "l_extendedprice AS amount", "try_divide(l_extendedprice, l_quantity) AS price", "CAST(l_linenumber = 7 AS INT) AS is_delivery", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr("p_partkey AS spec_id", "p_name", "concat(p_name, ' DN', p_size) AS name", "p_type AS section", "p_brand AS code", "CAST(p_size AS DOUBLE) AS quantity", "p_retailprice AS list_price", "p_size")


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a distinct linked line: confidence, confirmed, analog and source of the offer."""
    rows = items(spark, sf_dir).selectExpr("spec_id", "supplier_id", "invoice_id", "row_index", "quantity", "amount", "is_delivery", "CAST(100 - floor(l_discount * 100 + 0.5) - 5 * (row_index % 8) AS INT) AS score", "CAST(l_returnflag = 'R' AS INT) AS confirmed", "CAST(l_linestatus = 'O' AS INT) AS analog", "CASE WHEN supplier_id % 2 = 0 THEN 'invoice' ELSE 'price_list' END AS source")
    return rows.distinct()


#: Names of a bill of materials made from the size of a part, in the forms that occur; the same text runs in Spark and in DuckDB.
NAME = """CASE spec_id % 12
 WHEN 0 THEN concat('Труба стальная Ду ', CAST(p_size AS STRING), ' (ГОСТ 3262-75)') WHEN 1 THEN concat('Кран шаровой DN', CAST(p_size AS STRING), ' PN16')
 WHEN 2 THEN concat('Кабель ВВГ 3х', CAST(p_size AS STRING), ',5') WHEN 3 THEN concat('Воздуховод прямоугольный ', CAST(100 + p_size AS STRING), 'х', CAST(200 + p_size AS STRING), ' мм')
 WHEN 4 THEN concat('VC22-', CAST(100 + p_size AS STRING), '-80 Compact') WHEN 5 THEN concat('ø', CAST(p_size AS STRING)) WHEN 6 THEN concat('То же, Ду ', CAST(p_size AS STRING))
 WHEN 7 THEN concat('Клапан обратный CV Дн', CAST(p_size AS STRING), 'х3,50') WHEN 8 THEN concat('Радиатор EVRA Q=', CAST(1000 + p_size AS STRING), ' Вт Левое исполнение')
 WHEN 9 THEN concat('Кабeль силовой ', CAST(p_size AS STRING), ' м') WHEN 10 THEN concat('Труба ПП ', CAST(p_size AS STRING), '; отвод 90; переход ', CAST(p_size AS STRING))
 ELSE concat('Насос UPS 25-', CAST(10 + p_size AS STRING), '-180 исполнение IP44') END"""
_NAMED = (
    "spec_id", "p_brand AS sheet", f"{NAME} AS name", "CASE spec_id % 3 WHEN 0 THEN 'Вентиляция' WHEN 1 THEN 'ВК' END AS section",
    "CASE WHEN spec_id % 4 = 3 THEN NULL ELSE CAST(CAST(floor(spec_id / 24) AS BIGINT) AS STRING) END AS position_number",
    "CASE WHEN spec_id % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS quantity",
    "CASE spec_id % 6 WHEN 0 THEN 'шт.' WHEN 1 THEN 'шт' WHEN 2 THEN 'M' WHEN 3 THEN 'упаковка' WHEN 4 THEN 'к-т' END AS unit",
)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification lines with names, positions, quantities and units as they are written."""
    return read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "spec_id").selectExpr(*_NAMED)


#: The same views as DuckDB common table expressions, by name.
SQL = {
    "named": f"named AS (SELECT {', '.join(_NAMED)} FROM (SELECT *, p_partkey AS spec_id FROM part))",
    "suppliers": "suppliers AS (SELECT s_suppkey AS supplier_id, s_name AS supplier, CAST(s_suppkey % 2 AS INT) AS incl, CAST([0, 10, 20, 22][CAST((s_suppkey // 2) % 4 AS INT) + 1] AS DOUBLE) AS rate FROM supplier)",
    "invoices": "invoices AS (SELECT o_orderkey AS invoice_id, c_nationkey AS project_id, o_totalprice AS total, o_orderdate AS invoice_date, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey)",
    "items": "items AS (SELECT l_orderkey AS invoice_id, l_suppkey AS supplier_id, l_partkey AS spec_id, l_linenumber AS row_index, l_quantity AS quantity, l_extendedprice AS amount, l_extendedprice / nullif(l_quantity, 0) AS price, CAST(l_linenumber = 7 AS INT) AS is_delivery, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)",
    "specs": "specs AS (SELECT p_partkey AS spec_id, p_name, p_name || ' DN' || p_size AS name, p_type AS section, p_brand AS code, CAST(p_size AS DOUBLE) AS quantity, p_retailprice AS list_price, p_size FROM part)",
    "matched": "matched AS (SELECT DISTINCT l_partkey AS spec_id, l_suppkey AS supplier_id, l_orderkey AS invoice_id, l_linenumber AS row_index, l_quantity AS quantity, l_extendedprice AS amount, CAST(l_linenumber = 7 AS INT) AS is_delivery, CAST(100 - floor(l_discount * 100 + 0.5) - 5 * (l_linenumber % 8) AS INT) AS score, CAST(l_returnflag = 'R' AS INT) AS confirmed, CAST(l_linestatus = 'O' AS INT) AS analog, CASE WHEN l_suppkey % 2 = 0 THEN 'invoice' ELSE 'price_list' END AS source FROM lineitem)",
}


def with_views(names: str, body: str) -> str:
    """DuckDB SQL: the named views, then ``body`` (which may go on with more of them)."""
    return "WITH " + ", ".join(SQL[n] for n in names.split()) + body
