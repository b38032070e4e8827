"""Hierarchies of paged specifications: cases typed by hand, and a row-by-row brute force on random rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larkspan.operators import page_hierarchy as P

COLUMNS = "document long, ordinal long, name string, position_number string, quantity double, unit string, manufacturer string, parent_position string, parent_name_hint string"


def items(spark, *rows, document=1):
    """Rows of (name, position, quantity, unit, maker, parent's position, parent's name), as far as given."""
    return spark.createDataFrame([(document, i, *(tuple(r) + (None,) * 7)[:7]) for i, r in enumerate(rows)], COLUMNS)


def links(spark, *rows):
    got = P.linked_pages(P.page_items(items(spark, *rows))).orderBy("ordinal").collect()
    return [(r["name"], r["full_name"], r["parent"]) for r in got]


def test_codes_without_position_belong_to_the_numbered_row(spark):
    got = links(spark, ("Радиатор стальной С 11", "1", 13.0, "шт"), ("C11-300-500", None, 1.0, "шт"), ("C11-300-600", None, 1.0, "шт"))
    assert got == [("Радиатор стальной С 11", None, None), ("C11-300-500", "Радиатор стальной С 11 C11-300-500", 0), ("C11-300-600", "Радиатор стальной С 11 C11-300-600", 0)]


def test_diameters(spark):
    got = links(spark, ("Труба стальная", "1", 5.0, "м"), ("DN 50", None, 2.0, "м"), ("Ду 65, толстая", None, 3.0, "м"), ("Кран шаровой", "2", 1.0, "шт"), ("DN 15", None, 1.0, "шт"))
    assert [(n, p) for n, _, p in got] == [("Труба стальная", None), ("DN 50", 0), ("Ду 65, толстая", 0), ("Кран шаровой", None), ("DN 15", 3)] and got[4][1] == "Кран шаровой DN 15"


def test_the_same_is_spelt_out_from_the_root(spark):
    got = links(spark, ("Воздуховод 200x200", "1", 25.0, "м"), ("То же, 300x200",), ("То же",), ("Решетка РВ-1", "2", 5.0, "шт"), ("то  же РВ-2",))
    assert got == [("Воздуховод 200x200", None, None), ("Воздуховод 200x200 300x200", "Воздуховод 200x200 300x200", 0), ("Воздуховод 200x200", "Воздуховод 200x200", 0), ("Решетка РВ-1", None, None), ("Решетка РВ-1 РВ-2", "Решетка РВ-1 РВ-2", 3)]


def test_mixture(spark):
    got = links(spark, ("Радиатор С 22", "1", 1.0, "шт"), ("C22-300-500", None, 1.0, "шт"), ("То же, C22-400-500", None, 1.0, "шт"), ("DN 20", None, 1.0, "шт"), ("с боковым подключением",), ("C22-500-500", None, 1.0, "шт"))
    assert [p for _, _, p in got] == [None, 0, 0, 0, 0] and got[0][1] == "Радиатор С 22 с боковым подключением" and got[4][1] == "Радиатор С 22 с боковым подключением C22-500-500" and got[1][1] == "Радиатор С 22 C22-300-500"


def test_code_before_any_parent_stays_alone(spark):
    got = links(spark, ("C22-300-500", None, 1.0, "шт"), ("Радиатор алюминиевый", "1", 3.0, "шт"), ("C22-350-500",))
    assert got == [("C22-300-500", None, None), ("Радиатор алюминиевый", None, None), ("C22-350-500", "Радиатор алюминиевый C22-350-500", 1)]
    assert [p for _, _, p in links(spark, ("DN 50", None, 1.0, "м"), ("То же",), ("Труба", "1"))] == [None, None, None]


def test_bare_number_with_a_unit_stays_a_row(spark):
    assert [p for _, _, p in links(spark, ("Насос", "1", 1.0, "шт"), ("50", None, 2.0, "шт"), ("DN 50", None, 1.0, "шт"))] == [None, None, 1]


def test_numbered_products_with_sizes_stay_independent(spark):
    got = links(spark, ("Лоток 200x100", "1", 4.0, "м"), ("Короб 100х50 мм", "2", 4.0, "м"), ("300x200", "2", 1.0, "шт"))
    assert [(f, p) for _, f, p in got] == [(None, None)] * 3


def test_promotion_by_what_follows(spark):
    pipes = (("Кран шаровой", "1", 1.0, "шт"), ("Неподвижная опора",), ("Ø15", "12"), ("Ø25х3,2", None, 3.0, "м"), ("Кран угловой",), ("Насос", "2", 1.0, "шт"))
    got = P.linked_pages(P.page_items(items(spark, *pipes))).orderBy("ordinal").collect()
    assert [(r["name"], r["parent"], r["quantity"], r["position_number"], r["role"]) for r in got] == [("Кран шаровой", None, 1.0, "1", "group"), ("Неподвижная опора", None, None, None, "group"), ("Ø15", 1, 12.0, None, "child"), ("Ø25х3,2", 1, 3.0, None, "child"), ("Насос", None, 1.0, "2", "group")]
    # Without a diameter behind it the same row only goes on with the name above.
    assert got[1]["full_name"] == "Неподвижная опора Кран угловой"


def test_hints(spark):
    rows = (
        ("Клапан обратный муфтовый", "1", 1.0, "шт"), ("Насос циркуляционный UPS", None, 1.0, "шт"), ("исполнение А", None, 1.0, "шт", None, "1"), ("исполнение Б", None, 1.0, "шт", None, None, "Насос циркул"),
        ("исполнение В", None, 1.0, "шт", None, "77", "клапан обратный муфтовыи"), ("исполнение Г", None, 1.0, "шт", None, "77", "ничего такого"), ("исполнение Д", None, 1.0, "шт", None, None, "исполнение Г"), ("1", "1", 2.0, "шт"), ("исполнение Е", None, 1.0, "шт", None, "1"),
    )
    got = links(spark, *rows)
    # The hint of row 5 leads nowhere, so it begins a group, which the hint of row 6 then finds.
    assert [p for _, _, p in got] == [None, None, 0, 1, 0, None, 5, None, 7] and got[3][1] == "Насос циркуляционный UPS исполнение Б"


def test_sections_and_several_products(spark):
    got = links(spark, ("ОТОПЛЕНИЕ",), ("II. Материалы",), (" ",), (None,), ("Труба ПП; отвод 90; переход", "1", 4.0, "м"), ("Вентиляция приточная", None, None, None))
    assert got == [("Труба ПП", None, None), ("отвод 90", None, None), ("переход", None, None)]
    assert P.linked_pages(P.page_items(items(spark, ("a",)).where("false"))).count() == 0


# --- row by row -----------------------------------------------------------------------


def test_equal_to_row_by_row(spark):
    r = random.Random(3)
    names = ["Труба стальная", "Кран шаровой", "Опора неподвижная", "C22-300-500", "DN 50", "Ø15", "Ø25х3", "То же, 300x200", "из стали", "300x200", "Насос UPS", "исполнение 1"]
    docs = []
    for d in range(40):
        docs.append([(d, i, r.choice(names), r.choice([None, None, None, str(r.randint(1, 4))]), r.choice([None, 1.0]), r.choice([None, "шт"]), None, r.choice([None, None, "1", "3"]), r.choice([None, None, "труба", "кран шаровои", "насос ups из"])) for i in range(r.randint(1, 14))])
    got = P.linked_pages(spark.createDataFrame([x for rows in docs for x in rows], COLUMNS)).orderBy("document", "ordinal").collect()
    want = [(d, *x) for d, rows in enumerate(docs) for x in one_by_one([list(x[2:]) for x in rows])]
    assert [(x["document"], x["ordinal"], x["name"], x["full_name"], x["parent"]) for x in got] == want


def one_by_one(rows):
    """What the rules say of a document, with all that was before at hand."""
    form = lambda s: re.sub("[^a-zа-я0-9]+", " ", (s or "").lower().replace("ё", "е")).strip()
    flags = re.IGNORECASE
    last, sofar, kept, state = None, "", [], []
    for i, (name, pos, quantity, unit, maker, hint_pos, hint_name) in enumerate(rows):
        bare, dn, same = re.match(r"Ø\d", name), pos is None and re.match(P.DIAMETER[5:], name, flags), pos is None and re.match(r"то\s+же", name, flags)
        code = re.match(r"[A-Za-zА-Яа-я]{1,3}\s?\d{1,4}([-_]\d{2,4}){1,3}$", name)
        child = dn or code or re.search(P.SIZE[5:], name, flags)
        plain = quantity is None and unit is None and maker is None
        new = {"name": name, "full": None, "parent": None, "pos": pos, "gone": False}
        state.append(new)
        above = state[:i]

        def link(parent, root, new=new, name=name):
            new["parent"], new["full"] = parent, f"{root} {name}"

        if pos is not None and last is not None and bare:
            link(last, sofar)
            new["pos"] = None
            continue
        if pos is None and (hint_pos or hint_name):
            found = [j for j, x in enumerate(above) if x["pos"] == hint_pos and hint_pos]
            if not found and hint_name:
                scored = [(similar(form(hint_name), form(x["full"] or x["name"])), j) for j, x in enumerate(above) if x["parent"] is None]
                found = [j for s, j in [max(scored, default=(0, None))] if s >= 0.5]
            if found:
                link(found[-1], state[found[-1]]["full"] or state[found[-1]]["name"])
                continue
        heads = plain and pos is None and len(name) >= 5 and not child and not bare and len(re.findall("[а-яёa-z]", name, flags)) >= 4 and i + 1 < len(rows) and re.match(r"Ø\d", rows[i + 1][0])
        if same:
            if last is not None:
                rest = re.sub(r"^то\s+же[,\s]*", "", name, flags=flags).strip()
                new["name"] = new["full"] = f"{sofar} {rest}".strip()
                new["parent"] = last
        elif pos is None and not heads and last is not None and plain and not child:
            sofar = f"{sofar} {name}"
            state[last]["full"], new["parent"], new["gone"] = sofar, last, True
        elif pos is None and not heads and (dn or bare or (code and last is not None)):
            if last is not None:
                link(last, sofar)
        else:
            last, sofar = i, name
    at, n = {}, 0
    for i, x in enumerate(state):
        if not x["gone"]:
            at[i], n = n, n + 1
    return [(at[i], x["name"], x["full"], at.get(x["parent"])) for i, x in enumerate(state) if not x["gone"]]


def similar(a, b):
    if not a or not b:
        return 0
    if a == b:
        return 1
    if len(a) >= 4 and (a in b or b in a):
        return 0.9
    if min(len(a), len(b)) < 2:
        return 0
    left = [a[i : i + 2] for i in range(len(a) - 1)]
    shared = 0
    for g in (b[i : i + 2] for i in range(len(b) - 1)):
        if g in left:
            left.remove(g)
            shared += 1
    return 2 * shared / (len(a) + len(b) - 2)


@pytest.mark.parametrize(("name", "section"), [("ОТОПЛЕНИЕ", True), ("Вентиляция", True), ("IV. Трубы", True), ("Неподвижная опора", False), ("То же", False), ("АВТ", True)])
def test_sections(spark, name, section):
    got = spark.createDataFrame([(name, None, None)], "n string, q double, u string").select(P.is_section(F.col("n"), F.col("q"), F.col("u"))).first()[0]
    assert got is section


def test_a_parent_may_be_named_far_above(spark):
    """Over more than 600 rows: by position, by name, and by a name that went on."""
    far = [(f"Изделие {i}", str(1000 + i), 1.0, "шт") for i in range(700)]
    rows = (("Клапан обратный", "1", 1.0, "шт"), ("муфтовый латунный",), *far, ("исполнение А", None, 1.0, "шт", None, "1"), ("исполнение Б", None, 1.0, "шт", None, None, "клапан обратный муфтовый латунный"))
    got = {n: (f, p) for n, f, p in links(spark, *rows)}
    assert got["исполнение А"] == ("Клапан обратный муфтовый латунный исполнение А", 0) and got["исполнение Б"] == ("Клапан обратный муфтовый латунный исполнение Б", 0)


def test_no_row_gathers_the_names_above_it(spark):
    """Neither with a bound nor without one; the bound itself holds by position and by name."""
    rows = items(spark, ("Клапан", "1"), *[("Труба", str(10 + i)) for i in range(3)], ("а", None, None, None, None, "1"), ("б", None, None, None, None, None, "клапан"))
    t = rows.withColumns({"position": F.col("position_number"), "role": F.when(F.col("position_number").isNotNull(), "group").otherwise("child"), "group": F.col("ordinal"), "above": F.lit(None).cast("long")})
    for bound, want in ((None, [0, 0]), (5, [0, 0]), (4, [0, None]), (3, [None, None])):
        found = P.nearest_parent(t, bound)
        assert [r["parent"] for r in found.orderBy("ordinal").collect()] == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Window [" in line and "collect_list" in line]
