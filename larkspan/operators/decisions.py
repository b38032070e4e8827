"""What an operator decides, as one step: links, the rules that it teaches and the abbreviations that it shows change together.

Links and rules as in ``transitions``, the dictionary as in ``synonyms``.
``names``: (id, spec_pattern, offer_pattern) of links, both normalised; a link
without an offer's name cannot be decided on and stays as it is.  Every function
takes many links at once and gives back all tables that it may change; several
links of one rule count as often as they come.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators import synonyms as Y
from larkspan.operators import transitions as T

#: The kind of a link that a model proposed.
PROPOSED = "llm_suggestion"
CONFIRMED, BY_HAND, STEP, MOST = 0.92, 0.96, 0.02, 0.97


class Decided(NamedTuple):
    links: DataFrame
    rules: DataFrame
    dictionary: DataFrame


def _told(links: DataFrame, chosen: DataFrame, names: DataFrame) -> DataFrame:
    named = names.where("spec_pattern IS NOT NULL AND offer_pattern IS NOT NULL").select("id", "spec_pattern", "offer_pattern").dropDuplicates(["id"])
    return links.join(chosen.select("id").distinct(), "id", "left_semi").join(named, "id")


def _taught(rules: DataFrame, told: DataFrame) -> DataFrame:
    """Rules after every row of ``told`` (key, confidence, source) was confirmed, one after the other: the first one as an upsert, each more of the same key adds a use and ``STEP`` up to ``MOST``."""
    last = Window.partitionBy(*T.RULE_KEY).orderBy(F.desc("id"))
    counted = told.withColumns({"n": F.row_number().over(last), "more": F.count("*").over(Window.partitionBy(*T.RULE_KEY)) - 1}).where("n = 1")
    once = T.upsert_positive(rules, counted.select(*T.RULE_KEY, "confidence", "source")).alias("r")
    again = counted.where("more > 0").select(*T.RULE_KEY, "more").alias("m")
    on = (F.col("r.spec_pattern") == F.col("m.spec_pattern")) & (F.col("r.offer_pattern") == F.col("m.offer_pattern")) & F.col("r.supplier_id").eqNullSafe(F.col("m.supplier_id"))
    changed = {"confidence": F.when(F.col("m.more").isNotNull(), F.least(F.lit(MOST), F.col("r.confidence") + STEP * F.col("m.more"))).otherwise(F.col("r.confidence")), "times_used": F.col("r.times_used") + F.coalesce("m.more", F.lit(0)).cast("int")}
    return once.join(again, on, "left").select(*[changed.get(c, F.col(f"r.{c}")).alias(c) for c in rules.columns])


def confirmed(links: DataFrame, rules: DataFrame, dictionary: DataFrame, chosen: DataFrame, names: DataFrame) -> Decided:
    """Links are right: they are confirmed and selected, their names become rules of 0.92, and sure ones teach abbreviations."""
    told = _told(links, chosen, names)
    taught = told.withColumns({"link_confidence": F.col("confidence"), "confidence": F.lit(CONFIRMED), "source": F.when(F.col("match_type") == PROPOSED, "llm_confirm").otherwise("manual")})
    spoken = told.select(F.col("spec_pattern").alias("spec"), F.col("offer_pattern").alias("offer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return Decided(T.confirm(links, told.select("id")), _taught(rules, taught), Y.learned(dictionary, spoken))


def confirmed_as_analog(links: DataFrame, rules: DataFrame, dictionary: DataFrame, chosen: DataFrame, names: DataFrame) -> Decided:
    """Links are good replacements: confirmed as analogs, with rules of 0.75 for analogs; nothing is learnt of words."""
    told = _told(links, chosen, names)
    return Decided(T.confirm(links, told.select("id"), analog=True), T.upsert_analog(rules, told.select(*T.RULE_KEY)), dictionary)


def taken_back(links: DataFrame, rules: DataFrame, dictionary: DataFrame, chosen: DataFrame, names: DataFrame) -> Decided:
    """Links are open again and no longer selected; what a confirmed one had taught is used once less, or goes."""
    undone = _told(links, chosen, names).where("is_confirmed = 1")
    return Decided(T.unconfirm(links, chosen), T.roll_back_use(rules, undone), dictionary)


def rejected(links: DataFrame, rules: DataFrame, dictionary: DataFrame, chosen: DataFrame, names: DataFrame) -> Decided:
    """Links are wrong: they go, and names of those that were not confirmed are blocked for their supplier."""
    told = _told(links, chosen, names)
    return Decided(T.reject(links, told.select("id")), T.upsert_negative(rules, told.where("coalesce(is_confirmed, 0) = 0").select(*T.RULE_KEY)), dictionary)


def linked_by_hand(links: DataFrame, rules: DataFrame, dictionary: DataFrame, pairs: DataFrame) -> tuple[Decided, DataFrame]:
    """(tables, warnings) after an operator has linked (spec_id, offer_id, supplier_id, spec_pattern, offer_pattern) of invoices: rules of 0.96, and words are learnt."""
    after, warnings = T.manual_match(links, pairs)
    told = pairs.dropDuplicates(["spec_id", "offer_id"]).where("spec_pattern IS NOT NULL AND offer_pattern IS NOT NULL").withColumns({"id": F.col("offer_id"), "confidence": F.lit(BY_HAND), "source": F.lit("manual")})
    return Decided(after, _taught(rules, told), Y.learned(dictionary, told.select(F.col("spec_pattern").alias("spec"), F.col("offer_pattern").alias("offer"), "confidence"))), warnings
