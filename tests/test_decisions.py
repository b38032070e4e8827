"""Decisions of operators against the same done row by row, one decision after the other."""

import random

import pytest

from larkspan.operators import decisions as D
from larkspan.operators import synonyms as Y

LINKS = "id long, spec_id long, source string, offer_id long, supplier_id long, confidence double, match_type string, is_confirmed int, is_selected int, is_analog int"
RULES = "spec_pattern string, offer_pattern string, supplier_id long, confidence double, times_used int, is_negative int, is_analog int, source string"
KEY = ("spec_pattern", "offer_pattern", "supplier_id")


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    links = [(i, i // 3, "invoice", 100 + i, r.choice([None, 1, 2]), r.choice([0.5, 0.9]), r.choice(["llm_suggestion", "name_similarity"]), int(i % 4 == 0), int(i % 3 == 0), 0) for i in range(24)]
    names = [(i, r.choice(["пп труба", "кран"]), r.choice(["полипропилен труба", "кран шаровой", None])) for i in range(24)]
    known = {(r.choice(["пп труба", "кран"]), r.choice(["полипропилен труба", "кран шаровой"]), r.choice([None, 1, 2])) for _ in range(8)}
    rules = [(*k, r.choice([None, 0.5, 0.93, 0.96]), r.choice([1, 2]), r.choice([0, 0, 1]), r.choice([0, 0, 1]), r.choice(["import", "manual"])) for k in sorted(known, key=str)]
    return spark.createDataFrame(links, LINKS), spark.createDataFrame(rules, RULES), spark.createDataFrame(names, "id long, spec_pattern string, offer_pattern string"), links, rules, dict((n[0], n[1:]) for n in names)


def chosen(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def rows(df, *columns):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()), key=str)


IDS = (1, 5, 9, 10, 13, 16, 20, 21)


def told(links, names):
    return [(dict(zip(LINKS.replace(",", "").split()[::2], x, strict=True)), names[x[0]]) for x in links if x[0] in IDS and names[x[0]][1] is not None]


def as_dict(rules):
    return {tuple(x[:3]): list(x[3:]) for x in rules}


def test_confirmed(spark, tables):
    links, rules, names, raw_links, raw_rules, by_id = tables
    got = D.confirmed(links, rules, Y.seed(spark).where("false"), chosen(spark, *IDS), names)
    want, words = as_dict(raw_rules), set()
    for x, (spec, offer) in told(raw_links, by_id):
        source = "llm_confirm" if x["match_type"] == "llm_suggestion" else "manual"
        old = want.get((spec, offer, x["supplier_id"]))
        if old is None:
            want[spec, offer, x["supplier_id"]] = [0.92, 1, 0, 0, source]
        else:
            weak = old[2] or old[3] or old[0] is None or old[0] < 0.92
            want[spec, offer, x["supplier_id"]] = [0.92 if weak else min(0.97, old[0] + 0.02), old[1] + 1, 0, 0, old[4] if old[4] == "import" else source]
        if x["confidence"] >= 0.85 and "пп" in spec and "полипропилен" in offer:
            words.add(("пп", "полипропилен"))
    columns = ("confidence", "times_used", "is_negative", "is_analog", "source")
    assert rows(got.rules, *KEY, *columns) == sorted(((*k, *[round(x, 6) if isinstance(x, float) else x for x in v]) for k, v in want.items()), key=str)
    assert rows(got.dictionary, "abbreviation", "full_form") == sorted(words)
    done = {x["id"] for x, _ in told(raw_links, by_id)}
    assert {r["id"] for r in got.links.where("is_confirmed = 1").collect()} == done | {x[0] for x in raw_links if x[7]}


def test_rejected_and_taken_back(spark, tables):
    links, rules, names, raw_links, raw_rules, by_id = tables
    none = Y.seed(spark).where("false")
    got = D.rejected(links, rules, none, chosen(spark, *IDS), names)
    want = as_dict(raw_rules)
    blocked = {(*n, x["supplier_id"]) for x, n in told(raw_links, by_id) if not x["is_confirmed"] and x["supplier_id"] is not None}
    negative = {k for k, v in want.items() if v[2]} | blocked
    assert {tuple(r[c] for c in KEY) for r in got.rules.where("is_negative = 1").collect()} == negative
    assert {r["id"] for r in got.links.collect()} == {x[0] for x in raw_links} - {x["id"] for x, _ in told(raw_links, by_id)}
    back = D.taken_back(links, rules, none, chosen(spark, *IDS), names)
    assert back.links.where("is_confirmed + is_selected > 0").join(chosen(spark, *IDS), "id").count() == 0 and back.links.count() == 24
    undone = {(*n, x["supplier_id"]) for x, n in told(raw_links, by_id) if x["is_confirmed"]}
    left = {k: v[1] - (k in undone and not v[2]) for k, v in want.items() if not (k in undone and not v[2] and v[1] <= 1 and v[4] != "import")}
    got = {tuple(r[c] for c in KEY): r["times_used"] for r in back.rules.collect()}
    assert {k: v for k, v in got.items() if k not in undone} == {k: v for k, v in left.items() if k not in undone} and set(got) == set(left)


def test_analogs_and_links_by_hand(spark, tables):
    links, rules, names, raw_links, _, by_id = tables
    none = Y.seed(spark).where("false")
    got = D.confirmed_as_analog(links, rules, none, chosen(spark, *IDS), names)
    keys = {(*n, x["supplier_id"]) for x, n in told(raw_links, by_id)}
    assert {tuple(r[c] for c in KEY) for r in got.rules.where("is_analog = 1 AND confidence = 0.75").collect()} >= keys and got.dictionary.count() == 0
    pairs = spark.createDataFrame([(0, 100, 1, "пп отвод", "полипропилен отвод"), (5, 999, 2, "кран", "кран шаровой"), (5, 998, None, "x", None)], "spec_id long, offer_id long, supplier_id long, spec_pattern string, offer_pattern string")
    after, _ = D.linked_by_hand(links, rules.where("false"), none, pairs)
    assert rows(after.rules, *KEY, "confidence") == [("кран", "кран шаровой", 2, 0.96), ("пп отвод", "полипропилен отвод", 1, 0.96)]
    assert rows(after.dictionary, "abbreviation") == [("пп",)]
    assert rows(after.links.where("match_type = 'manual'"), "id", "spec_id", "offer_id") == [(24, 5, 998), (25, 5, 999)]
