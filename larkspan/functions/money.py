"""Prices and tax: every function takes and gives Columns.

Money is binary double rounded half up to cents; a price is tax-inclusive once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(x: Column) -> Column:
    """Half-up rounding to two decimals of the binary value."""
    return F.floor(x * 100 + 0.5).cast("double") / 100


def tax_factor(rate: Column) -> Column:
    return 1 + rate / 100


def _net_with_rate(rate: Column, included: Column) -> Column:
    return (included == 0) & rate.isNotNull() & (rate > 0)


def effective_price(price: Column, rate: Column, included: Column) -> Column:
    """The price with tax: net prices of suppliers with a rate are raised once."""
    return F.when(_net_with_rate(rate, included), cents(price * tax_factor(rate))).otherwise(price)


def unit_price_with_vat(price: Column, rate: Column, included: Column, quantity: Column, amount: Column) -> Column:
    """struct(price, source): from amount and quantity where both speak, else from the price."""
    line = F.when(_net_with_rate(rate, included), amount * tax_factor(rate)).otherwise(amount)
    derived = amount.isNotNull() & quantity.isNotNull() & (quantity > 0)
    return F.struct(
        F.when(derived, cents(F.try_divide(line, quantity))).otherwise(effective_price(price, rate, included)).alias("price"),
        F.when(derived, F.lit("derived_unit")).otherwise(F.lit("raw")).alias("source"),
    )


def convert_vat(value: Column, column_included: Column, rate: Column, supplier_included: Column) -> Column:
    """A value from the semantics of its column to those of its supplier; neutral columns and missing rates change nothing."""
    usable = rate.isNotNull() & (rate > 0)
    return (
        F.when(usable & (column_included == F.lit(True)) & (supplier_included == 0), cents(F.try_divide(value, tax_factor(rate))))
        .when(usable & (column_included == F.lit(False)) & (supplier_included == 1), cents(value * tax_factor(rate)))
        .otherwise(value)
    )


def vat_mismatch(column_included: Column, supplier_included: Column) -> Column:
    return F.coalesce(((column_included == F.lit(True)) & (supplier_included == 0)) | ((column_included == F.lit(False)) & (supplier_included == 1)), F.lit(False))


def rederived_price(price: Column, quantity: Column, amount: Column) -> Column:
    """amount / quantity where the given price is off by more than one percent."""
    expected = F.try_divide(amount, quantity)
    return F.when((quantity > 0) & (amount > 0) & (price > 0) & (F.abs(price - expected) / expected > 0.01), cents(expected)).otherwise(price)


def filled_triple(quantity: Column, price: Column, amount: Column) -> Column:
    """struct(quantity, price, amount) with one missing member filled from the others, in that order."""
    amount2 = F.coalesce(amount, F.when(quantity.isNotNull() & price.isNotNull(), cents(quantity * price)))
    price2 = F.coalesce(price, F.when(quantity > 0, cents(F.try_divide(amount2, quantity))))
    quantity2 = F.coalesce(quantity, F.when(price2 > 0, F.floor(F.try_divide(amount2, price2) * 1000 + 0.5) / 1000))
    return F.struct(quantity2.alias("quantity"), price2.alias("price"), amount2.alias("amount"))
