"""Parents of the rows of a paged specification: by what a row says of its parent, else by what it looks like and what follows it.

Items: document, ordinal (from 0 without gaps), name, position_number, quantity,
unit, manufacturer, parent_position, parent_name_hint.  The pass over a
document's rows has two facts to remember, whether any row has begun a group and
which one did last, so that windows over the document carry it; no row is
looked at in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.names import name_similarity, spaced_grams, split_products
from larkspan.functions.text import let
from larkspan.operators.hierarchy import CODED, DESIGNATED, SAME
from larkspan.sources.shared import discard, written

# How section heads, children by diameter, bare diameters and sizes begin or look in paged documents.
SECTION = r"(?iu)^(?:вентиляция|отопление|водоснабжение|канализация|тепломеханика|автоматизация|кондиционирование|электрика|слаботочка|материалы|оборудование|раздел)(?=\s|$|[^А-Яа-яЁёA-Za-z0-9])"
ROMAN = r"(?iu)^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\.?\s+"
CAPITALS = r"^[А-ЯЁA-Z\s]{3,20}$"
DIAMETER = r"(?iu)^(?:DN|Ду|Дн|d=|D=|du)\s*\d{2,}(?:\s|$|[xXхХ×/\-,])"
BARE = r"^Ø\d{1,4}"
SIZE = r"(?iu)^(?:δ|d|du|dn|ø|⌀)\s*=?\s*\d{1,4}|(?<![A-Za-z0-9_])\d{1,4}\s*[xх×]\s*\d{1,4}(?![A-Za-z0-9_])|^\d{2,4}[xх×]\d{2,4}$"
#: Rows above among which a parent that is named is sought, and the similarity that it needs.
LOOK_BACK, LIKE = 600, 0.5


def _test(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def is_section(name: Column, quantity: Column, unit: Column) -> Column:
    """A row that only parts the document: no quantity, no unit, a Roman number, a section's word or a few capitals."""
    n = F.trim(name)
    return quantity.isNull() & (F.trim(F.coalesce(unit, F.lit(""))) == "") & ~_test(n, SAME) & (_test(n, ROMAN) | _test(n, SECTION) | _test(n, CAPITALS))


def heads_children(name: Column) -> Column:
    """A name that can head a group: five characters with four letters, and no size at its start."""
    n = F.trim(name)
    sized = _test(n, BARE) | _test(n, DIAMETER) | _test(n, SIZE) | _test(n, r"(?iu)^δ\s*=")
    return (F.length(n) >= 5) & ~sized & (F.regexp_count(n, F.lit("[А-Яа-яЁёA-Za-z]")) >= 4)


def looks_like_child(name: Column) -> Column:
    n = F.trim(name)
    return _test(n, DIAMETER) | ((F.length(n) > 0) & (F.length(n) <= 25) & (_test(n, SIZE) | _test(n, DESIGNATED))) | _test(n, CODED)


def name_form(name: Column) -> Column:
    """Small letters and digits with one space between, for comparing a hint with a name."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(name, F.lit(""))), "ё", "е"), "[^a-zа-я0-9]+", " "))


def page_items(answer: DataFrame) -> DataFrame:
    """Items from rows (document, ordinal, and the others): empty names and section heads go, a row that names several products becomes one for each, of which the first keeps position, quantity and hints."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    rows = answer.where((F.trim(F.coalesce("name", F.lit(""))) != "") & ~is_section(F.col("name"), F.col("quantity"), F.col("unit")))
    parts = rows.select("document", F.col("ordinal").alias("row"), "quantity", *[text(c).alias(c) for c in ("position_number", "unit", "manufacturer", "parent_position", "parent_name_hint")], F.posexplode(split_products(F.trim("name"))).alias("part", "name"))
    first = lambda c: F.when(F.col("part") == 0, F.col(c)).alias(c)
    ordinal = (F.row_number().over(Window.partitionBy("document").orderBy("row", "part")) - 1).cast("long")
    return parts.select("document", ordinal.alias("ordinal"), "name", "unit", "manufacturer", *[first(c) for c in ("position_number", "quantity", "parent_position", "parent_name_hint")])


def _placed(items: DataFrame) -> DataFrame:
    """Items with role, above (the group's first row above) and group, given whether their hints are ``resolved``."""
    name, nopos = F.trim("name"), F.col("position_number").isNull()
    doc = Window.partitionBy("document").orderBy("ordinal")
    upto = doc.rowsBetween(Window.unboundedPreceding, -1)
    plain = F.col("quantity").isNull() & F.col("unit").isNull() & F.col("manufacturer").isNull()
    t = items.withColumns({"bare": _test(name, BARE), "dn": nopos & _test(name, DIAMETER), "same": nopos & _test(name, SAME), "code": nopos & _test(F.col("name"), CODED), "plain": plain, "child": looks_like_child(name), "told": nopos & F.col("resolved")})
    t = t.withColumn("heads", nopos & F.col("plain") & heads_children(name) & F.coalesce(F.lead("bare").over(doc), F.lit(False)))
    own = ~F.col("told") & ~F.col("same")
    opens = ~nopos | (own & ~F.col("dn") & ~F.col("bare"))  # what a row is while no group has begun
    t = t.withColumn("begun", F.coalesce(F.max(opens).over(upto), F.lit(False)))
    goes_on = nopos & own & ~F.col("heads") & F.col("plain") & ~F.col("child")
    later = (~nopos & ~F.col("bare")) | (nopos & own & (F.col("heads") | (~goes_on & ~F.col("dn") & ~F.col("bare") & ~F.col("code"))))
    role = (
        F.when(F.when(F.col("begun"), later).otherwise(opens), "group").when(F.col("told"), "told").when(~F.col("begun"), "single")
        .when(F.col("same"), "same").when(goes_on, "continued").otherwise("child")
    )
    t = t.withColumn("role", role)
    starts = F.when(F.col("role") == "group", F.col("ordinal"))
    t = t.withColumn("above", F.last(starts, ignorenulls=True).over(upto)).withColumn("group", F.coalesce(starts, F.col("above")))
    # A size in the column of positions is no position.
    return t.withColumn("position", F.when((F.col("role") == "child") & ~nopos, F.lit(None)).otherwise(F.col("position_number")))


def _named(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(document, target, form, score) of the names of a document that are like one that its rows ask for: every two distinct texts are compared once."""
    sides = [t.distinct().withColumn(g, spaced_grams(F.col(c))) for t, c, g in ((asked.select("document", "target"), "target", "x"), (entries.select("document", "form"), "form", "y"))]
    inside = F.contains("form", "target") | F.contains("target", "form")
    sized = (F.size("x") <= 3 * F.size("y")) & (F.size("y") <= 3 * F.size("x"))  # else the Dice is below a half
    score = name_similarity(F.col("target"), F.col("form"), F.col("x"), F.col("y"))
    return sides[0].join(sides[1], "document").where(inside | sized).select("document", "target", "form", score.alias("score")).where(F.col("score") >= LIKE)


def nearest_parent(items: DataFrame, look_back: int | None = None) -> DataFrame:
    """(document, ordinal, parent) of every row that says which its parent is: the nearest row above with the position that it names, else the row above whose name is most like the one that it names, the nearest of several.

    Items: document, ordinal, name, position, parent_position,
    parent_name_hint, role ("group" and "single" can be found by name;
    "continued" adds to the name of its group), group, above (the group that is
    open at a row, whose name may still go on; null for none).  ``look_back``:
    how many rows above count, all by default; names of such items do not go on.
    Null where neither is found.

    Positions meet in one window over (document, position).  A name is compared
    with the distinct names of its document, and the rows of those that are like
    it meet it in one window over (document, name asked for), so that no row's
    neighbours are gathered.  A name that goes on is found there by its whole
    form from its last row on; until then it is compared as far as it goes.
    """
    asks = F.col("position_number").isNull() & (F.col("parent_position").isNotNull() | F.col("parent_name_hint").isNotNull())
    t = items.withColumn("asks", asks)
    start = Window.unboundedPreceding if look_back is None else -look_back
    held = t.where("position IS NOT NULL").select("document", F.trim("position").alias("key"), "ordinal", F.col("ordinal").alias("found"))
    asked = t.where(F.col("asks") & F.col("parent_position").isNotNull()).select("document", F.col("parent_position").alias("key"), "ordinal", F.lit(None).cast("long").alias("found"))
    latest = F.last("found", ignorenulls=True).over(Window.partitionBy("document", "key").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    by_position = held.unionByName(asked).withColumn("latest", latest).where(F.col("found").isNull() & F.col("latest").isNotNull()).select("document", "ordinal", "latest")
    if look_back is not None:
        by_position = by_position.where(F.col("ordinal") - F.col("latest") <= look_back)

    said = t.where(F.col("role").isin("group", "single", "continued")).select("document", F.coalesce("group", "ordinal").alias("entry"), "ordinal", "name")
    joined = lambda parts: name_form(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(parts)), lambda p: p["name"])))
    entries = said.groupBy("document", F.col("entry").alias("ordinal")).agg(F.max("ordinal").alias("at"), joined(F.struct("ordinal", "name")).alias("form"))
    hinted = t.where(F.col("asks") & F.col("parent_name_hint").isNotNull()).select("document", "ordinal", "above", name_form(F.col("parent_name_hint")).alias("target")).where("target <> ''")

    found = entries.join(_named(hinted, entries), ["document", "form"]).select("document", "target", "at", F.struct("score", "ordinal").alias("entry"), F.lit(None).cast("long").alias("asking"))
    asking = hinted.select("document", "target", F.col("ordinal").alias("at"), F.lit(None).cast(found.schema["entry"].dataType).alias("entry"), F.col("ordinal").alias("asking"))
    best = F.max("entry").over(Window.partitionBy("document", "target").orderBy("at").rangeBetween(start, -1))
    closed = found.unionByName(asking).withColumn("best", best).where("asking IS NOT NULL").select("document", F.col("asking").alias("ordinal"), "best")

    parts = said.withColumnsRenamed({"entry": "above", "ordinal": "part"}).join(entries.where("at > ordinal").select("document", F.col("ordinal").alias("above"), "at"), ["document", "above"])
    sofar = hinted.join(parts, ["document", "above"]).where("part < ordinal AND ordinal <= at").groupBy("document", "ordinal", "above", "target").agg(joined(F.struct("part", "name")).alias("form"))
    current = sofar.select("document", "ordinal", F.struct(name_similarity(F.col("target"), F.col("form")).alias("score"), F.col("above").alias("ordinal")).alias("current")).where(F.col("current.score") >= LIKE)

    by_name = F.greatest("best", "current")["ordinal"]
    out = t.where("asks").select("document", "ordinal")
    for more in (by_position, closed, current):
        out = out.join(more, ["document", "ordinal"], "left")
    return out.select("document", "ordinal", F.coalesce("latest", by_name).alias("parent"))


def linked_pages(items: DataFrame) -> DataFrame:
    """(document, ordinal, position_number, name, full_name, parent, quantity, role) of the rows that stay, ordinals anew from 0.

    A row with a position begins a group, unless it is a bare diameter below one
    (then its position is its quantity).  A row without one belongs to the
    parent that it names; or repeats the group ("the same", spelt out); or
    begins a group if it has no quantity, unit or maker and a bare diameter
    follows; or goes on with the group's name, and does not stay; or is a child
    by diameter, size or code; or begins a group.  Before any group, children
    stay single.

    Which rows can be parents depends on which hints lead somewhere, and the
    other way round, always on rows above only: all are first taken to, and the
    pass is repeated until nothing changes.
    """
    asks = F.col("position_number").isNull() & (F.col("parent_position").isNotNull() | F.col("parent_name_hint").isNotNull())
    rows = written(items.withColumn("resolved", asks), "page-rows")
    while True:
        placed = written(_placed(rows), "page-placed")
        hints = written(nearest_parent(placed).where("parent IS NOT NULL"), "page-hints")
        again = placed.select(*rows.columns).join(hints.select("document", "ordinal", F.lit(True).alias("leads")), ["document", "ordinal"], "left")
        moved = again.withColumn("now", F.coalesce("leads", F.lit(False)))
        if moved.where(F.col("now") != F.col("resolved")).isEmpty():
            break
        old, rows = rows, written(moved.drop("resolved", "leads").withColumnRenamed("now", "resolved").select(*rows.columns), "page-rows")
        discard(old, hints, placed)

    group = Window.partitionBy("document", "group").orderBy("ordinal")
    continued, whole = F.when(F.col("role") == "continued", F.trim("name")), group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = placed.withColumns({"head": F.first("name").over(group), "sofar": F.collect_list(continued).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "more": F.collect_list(continued).over(whole)})
    t = t.withColumns({"accumulated": F.concat_ws(" ", F.array("head"), "sofar"), "complete": F.when((F.col("role") == "group") & (F.size("more") > 0), F.concat_ws(" ", F.array("head"), "more"))})
    roots = t.select("document", F.col("ordinal").alias("parent"), F.coalesce("complete", "name").alias("root"))
    linked = t.join(hints.withColumnRenamed("parent", "hinted"), ["document", "ordinal"], "left")
    parent = F.when(F.col("role") == "told", F.col("hinted")).when(F.col("role").isin("same", "child"), F.col("above"))
    linked = linked.withColumn("parent", parent).join(roots, ["document", "parent"], "left")
    root = F.when(F.col("parent") == F.col("above"), F.col("accumulated")).otherwise(F.col("root"))
    rest = F.trim(F.regexp_replace("name", r"(?iu)^то\s+же[,\s]*", ""))
    spelt = F.when(rest == "", root).otherwise(F.concat(root, F.lit(" "), rest))
    name = F.when(F.col("role") == "same", spelt).otherwise(F.col("name"))
    full = F.when(F.col("role") == "same", spelt).when(F.col("role").isin("told", "child"), F.trim(F.concat(root, F.lit(" "), "name"))).otherwise(F.col("complete"))
    misplaced = F.regexp_extract("position_number", r"^\s*([+-]?\d+\.?\d*)", 1).try_cast("double")
    quantity = F.when((F.col("role") == "child") & F.col("position_number").isNotNull(), F.coalesce("quantity", F.when(misplaced > 0, misplaced))).otherwise(F.col("quantity"))
    gone = F.coalesce(F.sum((F.col("role") == "continued").cast("long")).over(Window.partitionBy("document").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = linked.select("document", "ordinal", F.col("position").alias("position_number"), name.alias("name"), full.alias("full_name"), "parent", quantity.alias("quantity"), "role").withColumn("at", F.col("ordinal") - gone)
    at = out.select("document", F.col("ordinal").alias("parent"), F.col("at").alias("new_parent"))
    return out.where("role <> 'continued'").join(at, ["document", "parent"], "left").select("document", F.col("at").alias("ordinal"), "position_number", "name", "full_name", F.col("new_parent").alias("parent"), "quantity", "role")
