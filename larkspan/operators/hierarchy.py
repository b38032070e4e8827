"""Rows of a specification and their parents, in the order of the sheet.

Items: sheet, ordinal, name, position_number, quantity, unit.  What can be said
of a row by itself and its islands is windows; what a row means by all rows
before it is decided sheet by sheet (a sheet is a document, and so bounded).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.sources.shared import ship

# How child rows, repeats, continuations, sizes and codes begin or look.
DN_CHILD = r"(?iu)^(?:DN|Ду|d=|D=|du)\s*\d{2,}(?:\s|$|[xX×/\-])"
SAME = r"(?iu)^то\s+же"
CONTINUES = r"(?iu)^(?:толщиной|толщ\.|сечение|сеч\.|длиной|дл\.|шириной|высотой|диаметром|ø|h=|l=|w=|b=|с\s+нанесением|с\s+покрытием|класса\s+герметичности)"
SIZED = r"(?i)^(?:δ|d|du|dn|ø|⌀)\s*=?\s*\d{1,4}|(?<![A-Za-z0-9_])\d{1,4}\s*[xх×]\s*\d{1,4}(?![A-Za-z0-9_])|^\d{2,4}[xх×]\d{2,4}$"
DESIGNATED = r"(?i)^[A-Za-zА-Яа-я]{0,4}\d{2,4}[-xх×]\d{2,4}(?:[-\s]\d{2,4})?$"
CODED = r"^[A-Za-zА-Яа-я]{1,3}\s?\d{1,4}(?:[-_]\d{2,4}){1,3}$"


def merged_continuations(items: DataFrame) -> DataFrame:
    """Items without rows that only continue the row above; their names are joined to it in order.

    A row continues if it has no position and begins like a detail, or has
    neither position nor quantity nor unit; children by diameter never do, and
    the first row of a sheet has nothing to continue.
    """
    name = F.trim("name")
    nopos, child = F.col("position_number").isNull(), F.col("position_number").isNull() & name.rlike(DN_CHILD)
    goes_on = nopos & ~child & (name.rlike(CONTINUES) | (F.col("quantity").isNull() & F.col("unit").isNull()))
    before = Window.partitionBy("sheet").orderBy("ordinal")
    starts = (~goes_on | (F.row_number().over(before) == 1)).cast("int")
    placed = items.withColumn("starts", starts).withColumn("island", F.sum("starts").over(before))
    first = F.min_by(F.struct("ordinal", "position_number", "quantity", "unit"), "ordinal").alias("first")
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "name")))
    whole = placed.groupBy("sheet", "island").agg(first, F.array_join(F.transform(parts, lambda p: p["name"]), " ").alias("name"))
    return whole.select("sheet", "first.*", "name").select("sheet", "ordinal", "name", "position_number", "quantity", "unit")


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("ordinal")
    names, full, parents, kinds = rows["name"].tolist(), [], [], []
    positions = [p if isinstance(p, str) and p else None for p in rows["position_number"]]
    last = None
    dn, same, sized, designated, coded = (re.compile(p.replace("(?iu)", "(?i)")) for p in (DN_CHILD, SAME, SIZED, DESIGNATED, CODED))
    for i, name in enumerate(names):
        bare = name.strip()
        above = None if last is None else full[last] or names[last]
        parameter = 0 < len(bare) <= 25 and bool(sized.search(bare) or designated.search(bare))
        if positions[i] is None and dn.search(bare):
            kind, whole = "diameter", None if last is None else f"{names[last]} {name}"
        elif same.search(bare):
            kind, whole = "same", None
            if last is not None:
                rest = re.sub(r"^то\s+же[,\s]*", "", name, flags=re.IGNORECASE).strip()
                whole = f"{above} {rest}" if rest else above
                names[i] = whole
        elif last is not None and parameter and positions[i] is not None and positions[last] == positions[i]:
            kind, whole = "parameter", f"{above} {name}".strip()
        elif last is not None and positions[i] is None and coded.search(name):
            kind, whole = "variant", f"{above} {name}".strip()
        else:
            kind, whole = "own", None
        parents.append(None if kind == "own" or last is None else int(rows["ordinal"].iloc[last]))
        full.append(whole)
        kinds.append(kind)
        if kind in ("own", "same"):
            last = i
    return pd.DataFrame({"sheet": rows["sheet"], "ordinal": rows["ordinal"], "name": names, "full_name": full, "parent": pd.array(parents, "Int64"), "kind": kinds})


def linked_rows(items: DataFrame) -> DataFrame:
    """(sheet, ordinal, name, full_name, parent, kind): children take the name of the row above that is no child.

    diameter: a size without a position; same: "the same" with another detail,
    spelt out, and itself a parent of what follows; parameter: a size under its
    parent's position; variant: a code without a position; own: all others.
    """
    ship(items.sparkSession)
    return items.select("sheet", "ordinal", "name", "position_number").groupBy("sheet").applyInPandas(_linked, "sheet string, ordinal long, name string, full_name string, parent long, kind string")


def without_rows(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Linked rows without those of ``gone`` (sheet, ordinal), numbered anew from 0 without gaps; parents follow."""
    left = items.join(gone.select("sheet", "ordinal").distinct(), ["sheet", "ordinal"], "left_anti")
    numbered = left.withColumn("at", F.row_number().over(Window.partitionBy("sheet").orderBy("ordinal")) - 1)
    parents = numbered.select("sheet", F.col("ordinal").alias("parent"), F.col("at").cast("long").alias("new_parent"))
    return numbered.join(parents, ["sheet", "parent"], "left").select("sheet", F.col("at").cast("long").alias("ordinal"), "name", "full_name", F.col("new_parent").alias("parent"), "kind")
