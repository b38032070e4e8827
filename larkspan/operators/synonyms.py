"""The dictionary of abbreviations as a table: what it says, and what confirmed links add to it.

Dictionary: abbreviation, full_form, category, source, times_used; the first
three are its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.names import abbreviates
from larkspan.functions.synonyms import SEED

#: A dictionary is part of every plan that uses it; larger ones are refused.
MOST = 20_000
#: Confidence from which a confirmed link teaches.
SURE = 0.85
_COLUMNS = "abbreviation string, full_form string, category string, source string, times_used int"


def seed(spark) -> DataFrame:
    return spark.createDataFrame([(*x, "seed", 0) for x in SEED], _COLUMNS)


def as_mapping(dictionary: DataFrame) -> dict[str, str]:
    """abbreviation -> full form; of several of one abbreviation the one used most, then the first by text."""
    best = Window.partitionBy("a").orderBy(F.desc("times_used"), "f")
    rows = dictionary.select(F.lower(F.trim("abbreviation")).alias("a"), F.lower(F.trim("full_form")).alias("f"), "times_used").where("a <> '' AND f IS NOT NULL")
    found = rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("a", "f").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"a dictionary holds {MOST} abbreviations at most")
    return {r["a"]: r["f"] for r in sorted(found)}


def learned(dictionary: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The dictionary and what ``confirmed`` links (spec, offer: normalised names; confidence) add.

    A word of two letters or more that only one of two names has teaches the
    first word of the other name that it may abbreviate.  Links under ``SURE``
    teach nothing; what is known stays as it is.
    """
    sure = confirmed.where(F.col("confidence") >= SURE)
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    sides = sure.select(words("spec").alias("x"), words("offer").alias("y"))
    both = sides.unionByName(sides.select(F.col("y").alias("x"), F.col("x").alias("y")))
    short = both.select(F.explode(F.filter(F.array_except("x", "y"), lambda w: F.length(w) >= 2)).alias("abbreviation"), "y")
    pairs = short.select("abbreviation", F.get(F.filter("y", lambda w: abbreviates(F.col("abbreviation"), w)), F.lit(0)).alias("full_form")).where("full_form IS NOT NULL").distinct()
    new = pairs.select("abbreviation", "full_form", F.lit("общее").alias("category"), F.lit("learned").alias("source"), F.lit(1).alias("times_used"))
    return dictionary.unionByName(new.join(dictionary, ["abbreviation", "full_form", "category"], "left_anti").select(*dictionary.columns))
