"""Feedback of operators by the supplier that it is about.

Feedback: type, source, status, created_at, supplier_id, invoice_item_id,
price_list_item_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of what is not known.
NOBODY, UNKNOWN = "Без поставщика", "unknown"


def with_suppliers(feedback: DataFrame, invoice_items: DataFrame, invoices: DataFrame, list_items: DataFrame, lists: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Feedback with supplier: of its own id, else of its invoice, else of its price list; ``NOBODY`` where none has a name.

    invoice_items: id, invoice_id; list_items: id, list_id; invoices and lists:
    id, supplier_id; suppliers: id, name.  Which document counts hangs on the
    source (null: an invoice), so a row has a key for one of the two joins and
    none for the other; what has no key does not move to meet others.
    """
    by_invoice = invoice_items.select(F.col("id").alias("item_key"), "invoice_id").join(invoices.select(F.col("id").alias("invoice_id"), F.col("supplier_id").alias("of_invoice")), "invoice_id").drop("invoice_id")
    by_list = list_items.select(F.col("id").alias("list_key"), "list_id").join(lists.select(F.col("id").alias("list_id"), F.col("supplier_id").alias("of_list")), "list_id").drop("list_id")
    from_invoice = F.coalesce("source", F.lit("invoice")) == "invoice"
    keyed = feedback.withColumns({"item_key": F.when(from_invoice, F.col("invoice_item_id")), "list_key": F.when(F.col("source") == "price_list", F.col("price_list_item_id"))})
    known = keyed.join(by_invoice, "item_key", "left").join(by_list, "list_key", "left").withColumn("supplier_key", F.coalesce("supplier_id", "of_invoice", "of_list"))
    named = known.join(suppliers.select(F.col("id").alias("supplier_key"), F.col("name").alias("supplier_name")), "supplier_key", "left")
    return named.select(*feedback.columns, F.coalesce(F.nullif(F.trim("supplier_name"), F.lit("")), F.lit(NOBODY)).alias("supplier"))


def breakdown(feedback: DataFrame, since: str, status: str = "all") -> DataFrame:
    """(supplier, error_type, error_count, new_count, resolved_count) of feedback (with supplier) since a day; error_type is null in a supplier's total."""
    state = F.when(F.col("status") == "resolved", "resolved").otherwise("new")
    rows = feedback.where(F.to_date("created_at") >= F.lit(since).cast("date")).select("supplier", F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit(UNKNOWN)).alias("error_type"), state.alias("state"))
    if status != "all":
        rows = rows.where(F.col("state") == status)
    return rows.rollup("supplier", "error_type").agg(F.count("*").alias("error_count"), F.count_if(F.col("state") == "new").alias("new_count"), F.count_if(F.col("state") == "resolved").alias("resolved_count")).where("supplier IS NOT NULL")
