"""Tests, repairs and keys of item names, articles and units, as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkspan.functions.text import SPACE, any_of, collapsed, let, missing, replaced

# Sections of a building's services and the word stems that name them, in the order in which they are asked.
SECTIONS: dict[str, tuple[str, ...]] = {
    "Электрика": ("кабель", "провод", "автомат", "щит", "розетк", "выключател", "светильник", "лампа", "узо", "рубильник", "электро"),
    "ВК": ("труба", "задвижк", "кран", "клапан", "фильтр", "насос", "водосчётчик", "водосчетчик", "смесител", "унитаз", "раковин", "канализац", "водоснабж", "водоотвед", "сифон", "полотенцесуш"),
    "Вентиляция": ("вентилятор", "диффузор", "воздуховод", "решётк", "решетк", "клапан воздуш", "заслонк", "рекуператор", "приточн", "вытяжн"),
    "Отопление": ("радиатор", "котёл", "котел", "конвектор", "теплосчётчик", "теплосчетчик", "термостат", "коллектор"),
    "Тепломеханика/ИТП": ("теплообменник", "насосная", "итп", "тепловой пункт", "узел учёта", "узел учета", "теплоузел", "тепломеханик"),
    "Автоматизация": ("датчик", "контроллер", "автоматик", "привод", "кипиа", "кип и а", "термопар", "сигнализатор"),
    "Кондиционирование": ("кондиционер", "сплит", "фанкойл", "чиллер", "фреон", "мульти-сплит", "мультисплит", "vrv", "vrf"),
    "Слаботочка": ("камера", "видеонаблюд", "скуд", "домофон", "скс", "оптоволокн", "видеокамер", "контрол доступ", "охранн"),
}
# Units and how they are spelt.
UNIT_FORMS = {"м": ("м", "m", "sm"), "шт": ("шт", "штука", "pcs", "pc", "st"), "уп": ("уп", "упак", "упаковка"), "кор": ("кор", "коробка"), "компл": ("компл", "комплект", "к-т")}
# Attribute syntax that tells variants of one product apart.
VARIANT_MARKS = (
    rf"(?iu)(?:^|{SPACE})[А-Яа-яЁё]+(?:ое|ее){SPACE}+исполнени\S*",
    rf"(?iu)(?:^|{SPACE})[А-Яа-яЁё]+(?:ое|ее){SPACE}+подключени[ея]",
    rf"(?iu)(?:^|{SPACE})d{SPACE}*п{SPACE}*={SPACE}*\d+{SPACE}*мм",
    rf"(?iu)(?:^|{SPACE})Q{SPACE}*={SPACE}*[\d.,]+(?:{SPACE}*[ВвWw]т?\.?(?={SPACE}|$)|{SPACE}*(?=$))",
    rf"(?iu)(?:^|{SPACE})\d+(?:{SPACE}*,{SPACE}*\d+)*{SPACE}*этаж(?:и|а|ей)?(?={SPACE}|$)",
    rf"(?iu){SPACE}\d+{SPACE}*Вт\.?{SPACE}*$",
)
# Words that no supplier's name holds.
NO_SUPPLIER = (
    "условия", "самовывоз", "паспорт", "доставка", "отгрузка", "оплат", "гарантия", "возврат", "примечан", "внимание", "ответственност", "несет", "покупатель", "плательщик",
    "грузополучатель", "получатель", "порядк", "лицензия", "свидетельство", "сертификат", "информац",
)


def count_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the text."""
    total = F.lit(0)
    for word in words:
        total = total + F.contains(text, F.lit(word)).cast("int")
    return total


def section_of(name: Column, characteristics: Column | None = None) -> Column:
    """The first section one of whose stems stands in the name or the characteristics; null for none."""
    text = F.lower(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(characteristics, F.lit("")) if characteristics is not None else F.lit("")))
    return let(text, lambda t: F.coalesce(*[F.when(any_of(t, stems), F.lit(section)) for section, stems in SECTIONS.items()]))


def script_corruption(name: Column) -> Column:
    """struct(sandwich, latin_wedge): a digit or Latin letter, or a Latin letter, between two Cyrillic letters of one word.

    The letter kha is no anchor: it stands for the sign of multiplication.
    """
    anchor = "[\\x{0400}-\\x{0424}\\x{0426}-\\x{0444}\\x{0446}-\\x{04FF}]"
    inside = "[0-9A-Za-z\\x{0400}-\\x{04FF}]*"
    text = F.coalesce(name, F.lit(""))
    return F.struct(text.rlike(f"{anchor}{inside}[0-9A-Za-z]{inside}{anchor}").alias("sandwich"), text.rlike(f"{anchor}{inside}[A-Za-z]{inside}{anchor}").alias("latin_wedge"))


def double_text(cell: Column) -> Column:
    """Whether a shadow of ASCII glyphs runs through Cyrillic text."""
    return F.coalesce(cell.rlike("[\\x{0400}-\\x{04FF}][A-Za-z0-9][\\x{0400}-\\x{04FF}]") | cell.rlike(r"^\s*[A-Za-z0-9]{2,}(?=[\x{0400}-\x{04FF}])"), F.lit(False))


def repaired_cell(baseline: Column, other: Column) -> Column:
    """A second reading of a doubled cell where that reading is clean and not absurdly long, else the first one."""
    lines = F.split(other, "\n", 2)
    shadow = (F.size(lines) == 2) & lines[0].rlike(r"^[A-Za-z0-9 ]*[A-Za-z0-9][A-Za-z0-9 ]*$") & lines[1].rlike("[\\x{0400}-\\x{04FF}]")
    text = F.when(shadow, lines[1]).otherwise(F.coalesce(other, F.lit("")))
    return let(text, lambda t: _kept_reading(baseline, t))


def _kept_reading(baseline: Column, text: Column) -> Column:
    bad = (F.trim(text) == "") | double_text(text) | F.contains(text, F.lit("\ufffd")) | text.rlike("[\\x{0400}-\\x{04FF}]\\x{00A0}[\\x{0400}-\\x{04FF}]")
    return F.when(bad | (F.length(text) > F.greatest(F.lit(200), F.length(baseline) * 3)), baseline).otherwise(text)


def variant_marks(name: Column) -> Column:
    """struct(clean, marks, refused): the name without its variant syntax, and what was taken out, in order, each mark once.

    A name of which no letter would be left keeps all of it.
    """
    def taken(rest: Column, marks: Column, patterns: tuple[str, ...]) -> Column:
        if not patterns:
            return let(F.struct(collapsed(rest).alias("clean"), F.filter(F.transform(F.array_sort(marks), lambda p: p["m"]), lambda m: m != "").alias("marks")), verdict)
        found = lambda r: F.transform(F.regexp_extract_all(r, F.lit(patterns[0]), F.lit(0)), lambda m: F.struct(F.instr(r, m).alias("at"), F.trim(m).alias("m")))
        return let(F.struct(rest.alias("rest"), marks.alias("marks")), lambda x: taken(F.regexp_replace(x["rest"], patterns[0], " "), F.concat(x["marks"], found(x["rest"])), patterns[1:]))

    def verdict(x: Column) -> Column:
        refused = ~x["clean"].rlike("[A-Za-zА-Яа-яЁё]")
        once = F.filter(x["marks"], lambda m, i: ~F.exists(F.slice(x["marks"], F.lit(1), i), lambda k: F.lower(k) == F.lower(m)))
        return F.struct(F.when(refused, collapsed(F.coalesce(name, F.lit("")))).otherwise(x["clean"]).alias("clean"), F.when(refused, F.array().cast("array<string>")).otherwise(once).alias("marks"), (refused & (F.size(x["marks"]) > 0)).alias("refused"))

    padded = F.concat(F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" "))
    return taken(padded, F.array().cast("array<struct<at:int,m:string>>"), VARIANT_MARKS)


def merged_characteristics(existing: Column, marks: Column) -> Column:
    """``existing`` with the marks that it does not hold yet, joined by semicolons."""
    base = collapsed(F.coalesce(existing, F.lit("")))
    new = F.filter(marks, lambda m: ~F.contains(F.lower(base), F.lower(m)))
    new = F.filter(new, lambda m, i: ~F.exists(F.slice(new, F.lit(1), i), lambda k: F.lower(k) == F.lower(m)))
    return F.when(F.size(new) == 0, existing).otherwise(F.concat_ws("; ", missing(base), F.array_join(new, "; ")))


def split_products(name: Column) -> Column:
    """The products that one row names between at least two separators; else the name alone."""
    text = collapsed(F.coalesce(name, F.lit("")))
    parts = F.filter(F.transform(F.split(text, "[+;•]"), lambda p: F.regexp_replace(F.trim(p), r"^[-–—]\s*", "")), lambda p: F.length(p) >= 3)
    whole = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when((F.regexp_count(text, F.lit("[+;•]")) >= 2) & (F.size(parts) >= 2), parts).otherwise(whole)


def is_bare_fragment(name: Column) -> Column:
    """Whether a name says nothing without its parent: a size, a code, "the same", a few letters."""
    n = collapsed(F.coalesce(name, F.lit("")))
    short = n.rlike(r"(?iu)^(dn|ду|дн|d|ø|⌀|pn|ру|f|ф)\s*=?\s*[ø⌀]?\s*\d") | n.rlike(r"(?iu)^[a-zа-яё]{0,4}\d[\d\s.,xх×*/_+-]*$")
    return n.rlike(r"(?iu)^то\s+же") | (F.length(n) <= 12) | ((F.length(n) <= 28) & short)


def spaced_grams(text: Column) -> Column:
    """The bigrams of a text, spaces included, repeats numbered, so that shared ones are a set's intersection; none of a text of one character."""
    gram = lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda h: h == x)).cast("string")))
    return let(gram(text), numbered)


def name_similarity(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """Similarity of two names already brought to one form: 1 equal, 0.9 one inside the other, else the Dice of their bigrams, spaces included.

    ``x`` and ``y``: their ``spaced_grams``, where these are at hand.
    """
    sets = F.struct((spaced_grams(a) if x is None else x).alias("x"), (spaced_grams(b) if y is None else y).alias("y"))
    dice = F.when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(let(sets, lambda s: 2.0 * F.size(F.array_intersect(s["x"], s["y"])) / (F.size(s["x"]) + F.size(s["y"]))))
    empty = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(empty, 0.0).when(a == b, 1.0).when((F.length(a) >= 4) & (F.contains(b, a) | F.contains(a, b)), 0.9).otherwise(dice)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def tokens(text: Column) -> Column:
    """The distinct words of three letters or digits or more."""
    s = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё", "е"), r"[^\p{L}\p{N}\s]", " ")
    return F.filter(F.array_distinct(F.split(collapsed(s), " ")), lambda t: F.length(t) >= 3)


def abbreviates(short: Column, long: Column) -> Column:
    """Whether a word of two to four letters may stand for a longer one: the same first letter, all others inside."""
    a, e = F.lower(short), F.lower(long)
    letters = F.slice(F.split(a, ""), F.lit(2), F.greatest(F.length(a) - 1, F.lit(0)))
    fits = ~a.rlike("^[0-9]") & F.length(a).between(2, 4) & a.rlike(r"^[\p{L}0-9]+$") & (F.length(e) >= F.length(a) + 3) & (F.substring(e, 1, 1) == F.substring(a, 1, 1))
    return F.coalesce(fits & F.forall(letters, lambda c: F.contains(e, c)), F.lit(False))


def header_cell(value: Column) -> Column:
    """A header cell as words only."""
    return collapsed(F.regexp_replace(F.translate(F.lower(F.coalesce(value, F.lit(""))), "ё", "е"), r"[^\p{L}\p{N}\s]", " "))


def article_key(value: Column) -> Column:
    return F.lower(collapsed(F.coalesce(value, F.lit(""))))


def name_key(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(value, F.lit(""))), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def unit_key(value: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), rf"[.\s]+|{SPACE}+", ""))


def canonical_unit(unit: Column, paired: Column | None = None) -> Column:
    """One spelling for each unit; a lone "t" is a piece where the paired row counts pieces."""
    def of(u: Column) -> Column:
        known = F.coalesce(*[F.when(u.isin(*spellings), F.lit(form)) for form, spellings in UNIT_FORMS.items()], u)
        return known if paired is None else F.when((u == "t") & (paired == "шт"), F.lit("шт")).otherwise(known)

    return let(unit_key(unit), of)


def _read_again(text: str | None) -> str | None:
    try:
        again = text.encode("cp1251").decode()
    except (AttributeError, UnicodeError):
        return text
    return again if any("\u0400" <= c <= "\u04ff" for c in again) else text


@F.pandas_udf(StringType())
def repaired_encoding(texts: pd.Series) -> pd.Series:
    """UTF-8 text that was read as windows-1251 (which Spark's own functions do not write), read again where that gives Cyrillic letters."""
    return texts.map(_read_again)


def swapped_article(article: Column, name: Column) -> Column:
    """struct(article, name), exchanged where only the name looks like an article."""
    fits = lambda s: (F.length(s) <= 30) & ~s.rlike("[а-яёА-ЯЁ]{11,}")
    swap = F.coalesce((F.length(article) > 0) & ~fits(article) & fits(name), F.lit(False))
    return F.struct(F.when(swap, name).otherwise(article).alias("article"), F.when(swap, article).otherwise(name).alias("name"))


def radiator_name(name: Column) -> Column:
    """The one spelling of a family of radiators whose invoices write it in many ways."""
    pattern = r"(?iu)^\s*радиатор\s+рбс\s*-?\s*500\s*/\s*95\s*-?\s*(\d+)\s*(.*)$"
    low = F.lower(name)
    return F.when(low.rlike(pattern), F.trim(F.concat_ws(" ", F.lit("Радиатор РБС - 500 / 95 -"), F.regexp_extract(low, pattern, 1), missing(collapsed(F.regexp_extract(low, pattern, 2)))))).otherwise(name)


def supplier_name(raw: Column) -> Column:
    """A supplier's name from the text behind its label; null for conditions, sentences and scraps."""
    n = F.trim(F.regexp_replace(F.trim(F.substring_index(raw, ",", 1)), r"[.;:]+$", ""))
    return F.when(F.length(n).between(2, 80) & ~any_of(F.lower(n), NO_SUPPLIER), n)


def without_soft_hyphens(text: Column) -> Column:
    return replaced(text, [("\u00ad\\s*", ""), (r"-\n(?=[а-яa-z])", "")])
