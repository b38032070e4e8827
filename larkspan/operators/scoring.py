"""Comparison of extracted documents with their references.

Reference and result rows: doc, idx, name, article, price, quantity, unit.  What
depends on the order in which rows take their partners is decided document by
document (a document is bounded); everything else is joins and windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larkspan.functions import names as N
from larkspan.sources.shared import ship

STATUSES = ("OK", "FAIL", "MISSING_REF", "MISSING_RESULT", "EXTRA")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts, case and outer spaces aside."""
    return pd.Series([SequenceMatcher(None, (x or "").lower().strip(), (y or "").lower().strip()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _unknown(x: float | None) -> bool:
    return x is None or x != x


def _price_ok(expected: float | None, actual: float | None) -> bool:
    if _unknown(expected) or _unknown(actual):
        return False
    return actual == 0 if expected == 0 else abs(expected - actual) / abs(expected) <= 0.05


def _lists(column: pa.ListArray) -> list[list[tuple]]:
    """Lists of structs as lists of tuples; null as an empty one."""
    rows = zip(*[f.to_pylist() for f in column.flatten().flatten()], strict=True)
    return [list(islice(rows, n or 0)) for n in pc.list_value_length(column).to_pylist()]


_DDL = {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean"}


def _by_document(left: DataFrame, right: DataFrame, decide: Callable[[int, list, list], Iterator[tuple]], schema: pa.Schema) -> DataFrame:
    """The rows that ``decide`` makes of each document of ``left`` from the rows of both sides, sorted by their first columns.

    A document travels as one row with two lists, so that very many small
    documents come to Python a batch at a time.
    """
    ship(left.sparkSession)
    listed = lambda t, name: t.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*[c for c in t.columns if c != "doc"]))).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [row for doc, a, b in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), _lists(batch.column(2)), strict=True) for row in decide(doc, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(schema.types)], schema=schema)

    both = listed(left, "a").alias("l").join(listed(right, "b").alias("r"), F.col("l.doc").eqNullSafe(F.col("r.doc")), "left").select("l.doc", "a", "b")
    return both.mapInArrow(run, ", ".join(f"{n} {_DDL[t]}" for n, t in zip(schema.names, schema.types, strict=True)))


def _most_alike(name: str, matchers: list[SequenceMatcher], used: set[int]) -> tuple[float, int | None]:
    """The similarity and place of the first of the most similar texts that are left.

    A text is compared only where its length and letters leave room for more
    than the best so far.
    """
    free = [k for k in range(len(matchers)) if k not in used]
    if len(name) < 200:  # in longer texts frequent letters do not count, so that equal ones may have less
        for k in free:
            if matchers[k].b == name:
                return 1.0, k
    best, at = -1.0, None
    for k in free:
        m = matchers[k]
        m.set_seq1(name)
        if m.real_quick_ratio() > best and m.quick_ratio() > best and (sim := m.ratio()) > best:
            best, at = sim, k
    return best, at


def _greedy(doc: int, ref: list, result: list) -> Iterator[tuple]:
    matchers, used = [SequenceMatcher(None, "", (n or "").lower().strip()) for _, n, _ in result], set()
    for idx, name, price in ref:
        best, at = _most_alike((name or "").lower().strip(), matchers, used)
        hit = at is not None and best >= 0.75
        if hit:
            used.add(at)
        yield doc, idx, result[at][0] if hit else None, round(max(best, 0.0), 3), hit and _price_ok(price, result[at][2])


def greedy_assignment(ref: DataFrame, result: DataFrame) -> DataFrame:
    """(doc, idx, result_idx, similarity, price_ok): each reference row takes the most similar result row that is left, from 0.75, in order."""
    columns = ("doc", "idx", "name", "price")
    return _by_document(ref.select(*columns), result.select(*columns), _greedy, pa.schema({"doc": pa.int64(), "idx": pa.int64(), "result_idx": pa.int64(), "similarity": pa.float64(), "price_ok": pa.bool_()}))


def document_scores(assigned: DataFrame, result: DataFrame) -> DataFrame:
    """(doc, names, prices, count_ratio, score): half for names, three tenths for prices, two tenths for the number of rows."""
    n = result.groupBy("doc").agg(F.count("*").alias("found"))
    g = assigned.groupBy("doc").agg(F.count("*").alias("n"), F.avg(F.col("result_idx").isNotNull().cast("double")).alias("names"), F.avg(F.col("price_ok").cast("double")).alias("prices"))
    g = g.join(n, "doc", "left").withColumn("count_ratio", F.least("n", F.coalesce("found", F.lit(0))) / F.col("n"))
    return g.select("doc", "names", "prices", "count_ratio", (F.col("names") * 0.5 + F.col("prices") * 0.3 + F.col("count_ratio") * 0.2).alias("score"))


def _unique_articles(rows: DataFrame) -> DataFrame:
    keyed = rows.select("doc", "idx", F.regexp_replace(N.article_key(F.col("article")), " ", "").alias("key")).where("key <> ''")
    return keyed.groupBy("doc", "key").agg(F.min("idx").alias("idx"), F.count("*").alias("n")).where("n = 1").drop("n")


def row_pairs(ref: DataFrame, result: DataFrame) -> DataFrame:
    """(doc, ref_idx, result_idx, method): rows of an article that is unique on both sides, then rows of the same index that are still free, then what is left of either side."""
    by_article = _unique_articles(ref).withColumnRenamed("idx", "ref_idx").join(_unique_articles(result).withColumnRenamed("idx", "result_idx"), ["doc", "key"]).select("doc", "ref_idx", "result_idx", F.lit("article").alias("method"))
    r = ref.select("doc", F.col("idx").alias("ref_idx")).join(by_article, ["doc", "ref_idx"], "left_anti")
    free = result.select("doc", F.col("idx").alias("result_idx")).join(by_article, ["doc", "result_idx"], "left_anti")
    rest = r.withColumn("has_ref", F.lit(True)).join(free.withColumn("ref_idx", F.col("result_idx")), ["doc", "ref_idx"], "full")
    method = F.when(F.col("has_ref") & F.col("result_idx").isNotNull(), "position").when(F.col("has_ref"), "missing_result").otherwise("extra_result")
    return by_article.unionByName(rest.select("doc", F.when(F.col("has_ref"), F.col("ref_idx")).alias("ref_idx"), "result_idx", method.alias("method")))


def split_merge_clusters(ref: DataFrame, result: DataFrame) -> DataFrame:
    """(doc, first_idx, result_idx, similarity): two neighbouring reference rows that one result row stands for, by an article of either and names alike from 0.8."""
    order = Window.partitionBy("doc").orderBy("idx")
    key = lambda c: F.regexp_replace(N.article_key(F.col(c)), " ", "")
    pairs = ref.select("doc", F.col("idx").alias("first_idx"), F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce(F.lead("name").over(order), F.lit(""))).alias("both"), F.array_distinct(F.array(key("article"), F.regexp_replace(N.article_key(F.lead("article").over(order)), " ", ""))).alias("keys"), F.lead("idx").over(order).alias("next")).where("next IS NOT NULL")
    asked = pairs.select("doc", "first_idx", "both", F.explode("keys").alias("key")).where("key <> ''")
    hits = asked.join(result.select("doc", F.col("idx").alias("result_idx"), "name", key("article").alias("key")), ["doc", "key"])
    similarity = N.edit_similarity(N.article_key(F.col("both")), N.article_key(F.col("name")))
    return hits.withColumn("similarity", similarity).where("similarity >= 0.8").select("doc", "first_idx", "result_idx", (F.floor(F.col("similarity") * 1000 + 0.5) / 1000).alias("similarity")).distinct()


def without_vat_duplicates(items: DataFrame) -> DataFrame:
    """Items of documents that list goods without tax and some of them again with 20 % of it: the repeats go, their first lines take the tax.

    Two lines of a document are a pair if the later one costs 1.2 +- 0.015 times
    the earlier one and has its article or a name of similarity 0.78.  A
    document is touched only if three lines of either side pair by article.
    Candidates meet on the logarithm of the price, in steps of the tolerance.
    """
    ship(items.sparkSession)
    step = 0.0125  # log(1.215 / 1.2) rounded up
    t = items.where("price > 0").select("doc", "idx", "price", F.lower(F.regexp_replace(F.coalesce("article", F.lit("")), r"[^0-9A-Za-zЀ-ӿ]+", "")).alias("key"), F.lower(F.regexp_replace(F.coalesce("name", F.lit("")), r"[^0-9A-Za-zЀ-ӿ]+", "")).alias("text"))
    first = t.select("doc", "idx", "price", "key", "text", F.floor((F.log("price") + F.log(F.lit(1.2))) / step).alias("band"))
    second = t.select("doc", *[F.col(c).alias(f"{c}2") for c in ("idx", "price", "key", "text")], F.explode(F.transform(F.array(F.lit(-2), F.lit(-1), F.lit(0), F.lit(1), F.lit(2)), lambda k: F.floor(F.log("price") / step) + k)).alias("band"))
    close = first.join(second, ["doc", "band"]).where("idx < idx2 AND price2 > price AND abs(price2 / price - 1.2) <= 0.015").withColumn("by_article", F.expr("key <> '' AND key = key2"))
    alike = close.where("NOT by_article AND text <> '' AND text2 <> ''").where(ratio("text", "text2") >= 0.78)
    pairs = close.where("by_article").unionByName(alike)
    proof = pairs.where("by_article").groupBy("doc").agg(F.countDistinct("idx").alias("a"), F.countDistinct("idx2").alias("b")).where("a >= 3 AND b >= 3").select("doc")
    pairs = pairs.join(proof, "doc", "left_semi")
    net, again = pairs.select("doc", "idx", F.lit(True).alias("net")).distinct(), pairs.select("doc", F.col("idx2").alias("idx")).distinct()
    taxed = lambda c: F.when(F.col("net"), F.col(c) * 1.2).otherwise(F.col(c)).alias(c)
    return items.join(again, ["doc", "idx"], "left_anti").join(net, ["doc", "idx"], "left").select(*[taxed(c) if c in ("price", "amount") else c for c in items.columns])


def _merge(doc: int, base: list, other: list) -> Iterator[tuple]:
    by_article, by_name, used = defaultdict(list), defaultdict(list), set()
    for k, (_, _, article, name, _) in enumerate(other):
        by_article[article].append(k)
        by_name[name].append(k)
    conflict = lambda a, b: not (_unknown(a) or _unknown(b)) and abs(a - b) > max(0.001, abs(a) * 0.001)
    agree = lambda a, b: not (_unknown(a) or _unknown(b)) and not conflict(a, b)
    for idx, quantity, article, name, unit in base:
        free = lambda places, key: [k for k in places.get(key, ()) if k not in used] if key else []
        same = free(by_article, article) or free(by_name, name)
        fits = [k for k in same if not conflict(quantity, other[k][1]) and not (unit and other[k][4] and unit != other[k][4])]
        score = {k: 2 * agree(quantity, other[k][1]) + bool(unit and unit == other[k][4]) for k in fits}
        best = [k for k in fits if score[k] == max(score.values())] if len(fits) > 1 else fits
        taken = fits[0] if len(fits) == 1 else best[0] if len(best) == 1 and score[best[0]] > 0 else None
        if taken is not None:
            used.add(taken)
        yield doc, idx, None if taken is None else other[taken][0]


def confident_partners(base: DataFrame, other: DataFrame) -> DataFrame:
    """(doc, idx, other_idx): the row of a second reading that a row may take its price from.

    By article, else by name; rows whose quantity or unit disagree are out; of
    several the only one with the best agreement; a row serves once, in order.
    """
    def keyed(t: DataFrame) -> DataFrame:
        return t.select("doc", "idx", "quantity", N.article_key(F.col("article")).alias("article_key"), N.name_key(F.col("name")).alias("name_key"), N.unit_key(F.col("unit")).alias("unit_key"))

    return _by_document(keyed(base), keyed(other), _merge, pa.schema({"doc": pa.int64(), "idx": pa.int64(), "other_idx": pa.int64()}))


def field_status(has_ref: Column, has_result: Column, equal: Column) -> Column:
    return F.when(~has_ref, "MISSING_REF").when(~has_result, "MISSING_RESULT").when(F.coalesce(equal, F.lit(False)), "OK").otherwise("FAIL")


def monitor_status(score: Column) -> Column:
    """OK from 0.95, WARN from 0.85, else FAIL; a missing score fails."""
    return F.when(score >= 0.95, "OK").when(score >= 0.85, "WARN").otherwise("FAIL")
