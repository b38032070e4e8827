"""Every query of the catalogue against its SQL on the smallest tables, and golden vectors of the text functions."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspan.functions import money as M
from larkspan.functions import text as T
from larkspan.operators.similarity import dice_join
from larkspan.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)[:19]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_match_ranks_at_most_eight(spark):
    got = QUERIES["match_full_ladder"](spark, FOLDER).toPandas()
    assert len(got) and got["rank"].max() <= 8 and got["confidence"].between(0.3, 0.99).all()


@pytest.mark.parametrize(("text", "dn", "cross"), [("Труба Дн57х3,5", 57, "57x3.5"), ("Кран Ду 50", 50, None), ("Pipe DN-80", 80, None), ("Отвод 108x4,0", None, "108x4"), ("дно бака", None, None)])
def test_marking_features(spark, text, dn, cross):
    row = spark.createDataFrame([(text,)], "t string").select(T.marking_features(F.col("t")).alias("m")).first()["m"]
    assert (row["dn"], row["cross"]) == (dn, cross)


@pytest.mark.parametrize(("a", "b", "score"), [("Труба Дн57х3,5 6000", "Труба Дн57х3,5 3000", 1), ("Радиатор 500", "Радиатор 600", -1), ("Кран Ду 50", "Кран", -1), ("Кран", "Кран", 0), ("Тройник 16-20-16", "Тройник 16-16-16", -1), ("Клапан CV", "Клапан CVL", -1)])
def test_structural_score(spark, a, b, score):
    t = spark.createDataFrame([(a, b)], "a string, b string")
    assert t.select(T.structural_score(T.marking_features(F.col("a")), T.marking_features(F.col("b")))).first()[0] == score


@pytest.mark.parametrize("column", [True, False, None])
@pytest.mark.parametrize("supplier", [0, 1])
@pytest.mark.parametrize("rate", [20.0, 22.0, None])
def test_tax_once(spark, column, supplier, rate):
    t = spark.createDataFrame([(100.0, column, rate, supplier)], "v double, c boolean, r double, s int")
    got = t.select(M.convert_vat(F.col("v"), F.col("c"), F.col("r"), F.col("s"))).first()[0]
    factor = 1 if rate is None else 1 + rate / 100
    expected = 100 / factor if column is True and supplier == 0 else 100 * factor if column is False and supplier == 1 else 100
    assert got == pytest.approx(expected, abs=0.006)


def test_dice_join_equals_brute_force(spark):
    names = ["red bolt", "red bolts", "blue nut", "a", "a", "bolt red", ""]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string")

    def dice(x, y):
        x, y = x.replace(" ", ""), y.replace(" ", "")
        if x == y:
            return 1.0
        if len(x) < 2 or len(y) < 2:
            return 0.0
        gx, gy = [x[i : i + 2] for i in range(len(x) - 1)], [y[i : i + 2] for i in range(len(y) - 1)]
        return 2 * sum(min(gx.count(g), gy.count(g)) for g in set(gx)) / (len(gx) + len(gy))

    want = {(i, j): dice(x, y) for i, x in enumerate(names) for j, y in enumerate(names) if dice(x, y) >= 0.5}
    got = {(r["a"], r["b"]): r["dice"] for r in dice_join(table, table, 0.5).collect()}
    assert got == pytest.approx(want)


def test_tax_number_checksum(spark):
    t = spark.createDataFrame([("7707083893",), ("7707083894",), ("500100732259",), ("x",), (None,)], "t string")
    assert [r[0] for r in t.select(T.tax_id_valid(F.col("t"))).collect()] == [True, False, True, False, False]


def test_patterns_of_a_text_are_tried_once(spark):
    """The written month is read by one search and its three parts, not once for every month; texts without what a pattern needs give nothing."""
    from larkspan.functions import documents as D

    texts = ["Счёт № A-1 от 5 Марта 2024, ООО «Вектор» итого 1 234,50", "123 мая 20245", "invoice #7 date: 1.2.2023 продавец: банк", "ИП Иванов, скидка 5,5 %", "пусто", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", D.metadata(F.col("t")).alias("m"))
    rows = [tuple(r["m"]) for r in got.orderBy("i").collect()]
    assert rows[0] == ("A-1", "05.03.2024", "ООО Вектор", 1234.5, None) and rows[1][1] == "23.05.2024" and rows[2][:3] == ("7", "1.2.2023", "банк") and rows[3][4] == 5.5
    assert rows[4] == rows[5] == rows[6] == (None,) * 5
    assert got._jdf.queryExecution().optimizedPlan().toString().count("января|февраля") <= 4
