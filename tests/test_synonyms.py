"""Abbreviations: one pass against one replacement after the other, the dictionary as a table, and what links teach."""

import random
import re

from pyspark.sql import functions as F

from larkspan.functions import synonyms as Y
from larkspan.functions import text as T
from larkspan.operators import synonyms as D


def values(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_one_pass_equals_one_by_one(spark):
    r = random.Random(4)
    dictionary = {"ls": "low smoke", "lsltx": "very low smoke", "pn": "pressure", "a-b": "a to b", "gv": "gate valve", "gv/s": "gate valve with spindle", "x+": "extra"}
    pieces = ["LS", "lsltx", "ls-", "PN", "pn16", "a-b", "A-B.", "gv", "gv/s", "gvs", "x+", "x+ ", "pipe", "$1", "\\", "ls ls"]
    texts = [None, "", *[" ".join(r.choice(pieces) for _ in range(r.randint(1, 7))) for _ in range(80)]]

    def replaced(t):
        if t is None:
            return None
        ordered = sorted(dictionary, key=lambda w: -len(w))
        edge = lambda w: (r"(?<!\w)" if re.match(r"\w", w[0]) else r"(?<=\w)", r"(?!\w)" if re.match(r"\w", w[-1]) else r"(?=\w)")
        return re.sub("|".join(edge(w)[0] + re.escape(w) + edge(w)[1] for w in ordered), lambda m: dictionary[m.group().lower()], t, flags=re.I | re.A)

    assert values(spark, texts, lambda t: Y.expanded(t, dictionary)) == [replaced(t) for t in texts]
    assert values(spark, texts, lambda t: Y.expanded(t, {})) == texts


def test_names_with_abbreviations(spark):
    known = D.as_mapping(D.seed(spark))
    assert len(known) == len({a for a, _, _ in Y.SEED}) and known["ls"] == "низкое дымовыделение"
    got = values(spark, ["Кабель нг-LS 3х2,5", "Кабель 2lsltx", None, "LSLTX"], lambda t: T.normalized(t, constructions=known))
    assert got == ["кабель нг низкое дымовыделение 3x2 5", "кабель 2lsltx", "", "низкое дымовыделение"]


def test_a_table_of_several_full_forms(spark):
    rows = [(" PN ", "Pressure", "x", "seed", 1), ("pn", "nominal", "x", "learned", 5), ("q", None, "x", "seed", 0), ("", "nothing", "x", "seed", 0), ("r", "b", "x", "seed", 1), ("r", "a", "y", "seed", 1)]
    assert D.as_mapping(spark.createDataFrame(rows, D._COLUMNS)) == {"pn": "nominal", "r": "a"}


def test_what_links_teach(spark):
    known = spark.createDataFrame([("кш", "краншаровой", "общее", "seed", 3)], D._COLUMNS)
    links = [("кш dn 50", "краншаровой dn 50", 0.9), ("пп труба", "труба полипропилен", 0.85), ("мв", "минвата утеплитель", 0.84), ("труба полипропилен", "пп труба", 0.99), ("50 кран", "50x32x50 кран", 0.9), ("a", "abcdef", 0.9), (None, "x", 1.0)]
    got = D.learned(known, spark.createDataFrame(links, "spec string, offer string, confidence double"))
    assert sorted((r["abbreviation"], r["full_form"], r["source"], r["times_used"]) for r in got.collect()) == [("кш", "краншаровой", "seed", 3), ("пп", "полипропилен", "learned", 1)]
    assert D.learned(known, spark.createDataFrame([], "spec string, offer string, confidence double")).count() == 1
