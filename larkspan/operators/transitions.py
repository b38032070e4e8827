"""State transitions of links and rules as functions from tables to tables.

Links: id, spec_id, source, offer_id, supplier_id, confidence, match_type,
is_confirmed, is_selected, is_analog.  Rules: spec_pattern, offer_pattern,
supplier_id, confidence, times_used, is_negative, is_analog, source; their first
three columns are the key, with null as a value.  Ids of links that an action
names come as a table with a column id.  Every action is one pass of joins by
spec or rule key; nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.versions import dense_ids

RULE_KEY = ("spec_pattern", "offer_pattern", "supplier_id")


def _marked(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """``links`` with chosen (the link is named) and touched (a link of its spec is)."""
    named = links.join(chosen.select("id").distinct().withColumn("chosen", F.lit(True)), "id", "left")
    specs = links.join(chosen.select("id"), "id", "left_semi").select("spec_id").distinct().withColumn("touched", F.lit(True))
    return named.join(specs, "spec_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))).withColumn("touched", F.coalesce("touched", F.lit(False)))


def _updated(links: DataFrame, marked: DataFrame, **changes: Column) -> DataFrame:
    return marked.withColumns(changes).select(*links.columns)


def _flag(chosen: int, touched: int | str) -> Column:
    """``chosen`` for named links, ``touched`` (a value or a column) for others of their specs."""
    return F.when(F.col("chosen"), chosen).otherwise(F.lit(touched) if isinstance(touched, int) else F.col(touched)).cast("int")


def run_matching(links: DataFrame, candidates: DataFrame, incremental: bool = False) -> DataFrame:
    """Links after a run: confirmed ones stay, unconfirmed ones go (incremental: only of specs without a confirmed link), candidates come in.

    ``candidates``: columns of links but the flags, with dn_score and
    quantity_score.  The best one of a spec by dn_score, quantity_score and
    confidence, then the smallest offer, is selected.  Specs with a confirmed
    link take no candidates.
    """
    settled = links.where("is_confirmed = 1").select("spec_id").distinct()
    stays = links.where("is_confirmed = 1")
    if incremental:
        stays = stays.unionByName(links.where("is_confirmed = 0").join(settled, "spec_id", "left_semi"))
    order = Window.partitionBy("spec_id").orderBy(F.desc("dn_score"), F.desc("quantity_score"), F.desc("confidence"), "offer_id", "source")
    new = candidates.join(settled, "spec_id", "left_anti").withColumns({"is_selected": (F.row_number().over(order) == 1).cast("int"), "is_confirmed": F.lit(0)})
    return stays.unionByName(new.select(*links.columns))


def confirm(links: DataFrame, chosen: DataFrame, analog: bool = False) -> DataFrame:
    """Named links are confirmed and selected, as originals or as analogs; the others of their specs lose the selection."""
    m = _marked(links, chosen)
    return _updated(links, m, is_confirmed=_flag(1, "is_confirmed"), is_analog=_flag(int(analog), "is_analog"), is_selected=F.when(F.col("touched"), _flag(1, 0)).otherwise(F.col("is_selected")).cast("int"))


def unconfirm(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Named links are open again and no longer selected."""
    return _updated(links, _marked(links, chosen), is_confirmed=_flag(0, "is_confirmed"), is_selected=_flag(0, "is_selected"))


def reject(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Links without the named ones."""
    return links.join(chosen.select("id").distinct(), "id", "left_anti")


def select_price(links: DataFrame, chosen: DataFrame) -> DataFrame:
    """Within the specs of named links only these are selected."""
    return _updated(links, _marked(links, chosen), is_selected=F.when(F.col("touched"), _flag(1, 0)).otherwise(F.col("is_selected")).cast("int"))


def manual_match(links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, warnings) after an operator has linked (spec_id, offer_id, supplier_id) of invoices by hand.

    A pair that is linked already is confirmed, any other comes in with
    confidence 1 and an id behind all others, numbered by spec and offer.  Warnings name
    (spec_id, offer_id, other_spec_id) where the offer of a new pair is confirmed
    for another spec.
    """
    invoice = links.where("coalesce(source, 'invoice') = 'invoice'")
    known = invoice.join(pairs.select("spec_id", "offer_id").distinct(), ["spec_id", "offer_id"], "left_semi")
    new = pairs.select("spec_id", "offer_id", "supplier_id").dropDuplicates(["spec_id", "offer_id"]).join(invoice, ["spec_id", "offer_id"], "left_anti")
    taken = invoice.where("is_confirmed = 1").select("offer_id", F.col("spec_id").alias("other_spec_id")).distinct()
    warnings = new.join(taken, "offer_id").where("other_spec_id <> spec_id").select("spec_id", "offer_id", "other_spec_id")
    numbered = dense_ids(new, "spec_id", "offer_id", after=links.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    came = numbered.withColumns({"source": F.lit("invoice"), "confidence": F.lit(1.0), "match_type": F.lit("manual"), "is_confirmed": F.lit(1), "is_selected": F.lit(1), "is_analog": F.lit(0)})
    rest = confirm(links, known.select("id"))
    rest = rest.join(came.select("spec_id").distinct().withColumn("new_one", F.lit(True)), "spec_id", "left").withColumn("is_selected", F.when(F.col("new_one"), 0).otherwise(F.col("is_selected")).cast("int")).select(*links.columns)
    return rest.unionByName(came.select(*[F.col(c).cast(links.schema[c].dataType) for c in links.columns])), warnings


def group_confirm(links: DataFrame, groups: DataFrame) -> DataFrame:
    """(spec_id, leader_id, bucket, match_id) of the followers of groups (leader_id, source, offer_id, spec_id: the leader's confirmed offer, one row a follower).

    conflicted: the follower has a confirmed link; auto: it has one to the
    leader's offer, named in match_id; skipped: it has none.
    """
    confirmed = links.where("is_confirmed = 1").select("spec_id").distinct().withColumn("settled", F.lit(True))
    same = links.groupBy("spec_id", F.coalesce("source", F.lit("invoice")).alias("source"), "offer_id").agg(F.min("id").alias("match_id"))
    t = groups.join(confirmed, "spec_id", "left").join(same, ["spec_id", "source", "offer_id"], "left")
    bucket = F.when(F.col("settled"), "conflicted").when(F.col("match_id").isNotNull(), "auto").otherwise("skipped")
    return t.select("spec_id", "leader_id", bucket.alias("bucket"), F.when(bucket == "auto", F.col("match_id")).alias("match_id"))


def _upsert(rules: DataFrame, new: DataFrame, merged: dict[str, Column]) -> DataFrame:
    """Full outer join by the null-safe rule key; ``merged`` says what becomes of a rule that was there (o) and comes again (n)."""
    o, n = rules.alias("o"), new.dropDuplicates(list(RULE_KEY)).alias("n")
    on = (F.col("o.spec_pattern") == F.col("n.spec_pattern")) & (F.col("o.offer_pattern") == F.col("n.offer_pattern")) & F.col("o.supplier_id").eqNullSafe(F.col("n.supplier_id"))
    had, comes = F.col("o.spec_pattern").isNotNull(), F.col("n.spec_pattern").isNotNull()
    values = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in RULE_KEY]
    values += [F.when(had & comes, merged[c]).when(comes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("confidence", "times_used", "is_negative", "is_analog", "source")]
    return o.join(n, on, "full").select(*values)


def _once_more() -> Column:
    return F.coalesce(F.col("o.times_used"), F.lit(0)) + 1


def upsert_positive(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules after confirmations (key, confidence, source): a weaker, negative or analog rule takes the new confidence, others gain 0.02 up to 0.97; imported rules keep their source against operators."""
    weaker = (F.coalesce("o.is_negative", F.lit(0)) == 1) | (F.coalesce("o.is_analog", F.lit(0)) == 1) | F.col("o.confidence").isNull() | (F.col("o.confidence") < F.col("n.confidence"))
    sticky = (F.col("o.source") == "import") & F.col("n.source").isin("manual", "llm_confirm")
    full = new.withColumns({"times_used": F.lit(1), "is_negative": F.lit(0), "is_analog": F.lit(0)})
    return _upsert(rules, full, {"confidence": F.when(weaker, F.col("n.confidence")).otherwise(F.least(F.lit(0.97), F.col("o.confidence") + 0.02)), "times_used": _once_more(), "is_negative": F.lit(0), "is_analog": F.lit(0), "source": F.when(sticky, F.col("o.source")).otherwise(F.col("n.source"))})


def upsert_negative(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules after rejections (key): the pair is blocked; a rejection without a supplier teaches nothing."""
    values = {"confidence": F.lit(0.0), "is_negative": F.lit(1), "is_analog": F.lit(0), "source": F.lit("reject")}
    return _upsert(rules, new.where("supplier_id IS NOT NULL").withColumns(values | {"times_used": F.lit(1)}), values | {"times_used": _once_more()})


def upsert_analog(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Rules after pairs (key) were confirmed as analogs."""
    values = {"confidence": F.lit(0.75), "is_negative": F.lit(0), "is_analog": F.lit(1), "source": F.lit("manual")}
    return _upsert(rules, new.withColumns(values | {"times_used": F.lit(1)}), values | {"times_used": _once_more()})


def roll_back_use(rules: DataFrame, undone: DataFrame) -> DataFrame:
    """Rules after confirmations (key) were taken back: one use less; a rule of one use goes unless it was imported or is negative."""
    u = undone.select(*RULE_KEY).distinct().alias("u")
    r = rules.alias("r")
    on = (F.col("r.spec_pattern") == F.col("u.spec_pattern")) & (F.col("r.offer_pattern") == F.col("u.offer_pattern")) & F.col("r.supplier_id").eqNullSafe(F.col("u.supplier_id"))
    hit = F.col("u.spec_pattern").isNotNull() & (F.coalesce("r.is_negative", F.lit(0)) == 0)
    used = F.coalesce("r.times_used", F.lit(1))
    t = r.join(u, on, "left").where(~(hit & (used <= 1) & (F.coalesce("r.source", F.lit("manual")) != "import")))
    return t.select(*[F.when(hit & (used > 1), used - 1).otherwise(F.col("r.times_used")).alias(c) if c == "times_used" else F.col(f"r.{c}") for c in rules.columns])


def judged(links: DataFrame, answers: DataFrame, low: float = 0.25, high: float = 0.4, first: int = 10, asked: int = 5) -> DataFrame:
    """Links after a judge (id, answer yes or no) has seen the weakest open ones: of the first ten from ``low`` to under ``high`` by confidence, five are asked; yes lifts to 0.7, no deletes."""
    band = links.where(f"is_confirmed = 0 AND confidence >= {low} AND confidence < {high}").orderBy(F.desc("confidence"), "id").limit(first).orderBy(F.desc("confidence"), "id").limit(asked)
    said = band.select("id").join(answers.select("id", "answer"), "id")  # ``asked`` rows at most
    t = links.join(F.broadcast(said), "id", "left").where("coalesce(answer, 'yes') <> 'no'")
    return t.withColumn("confidence", F.when(F.col("answer") == "yes", F.lit(0.7)).otherwise(F.col("confidence"))).select(*links.columns)
