"""Normalisation of engineering item names and the features read from them.

Word edges are those of ASCII words, so that markers beside Cyrillic letters
behave as in the data the rules were made for.  All patterns run in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the source data means it: with no-break, thin and ideographic spaces.
SPACE = "[\\s\\u00a0\\ufeff\\u2000-\\u200a\\u202f\\u3000]"
_IN = r"(?<![A-Za-z0-9_])"
_OUT = r"(?![A-Za-z0-9_])"
_AFTER = r"(?<=[A-Za-z0-9_])"
_BEFORE = r"(?=[A-Za-z0-9_])"

# Words that carry no meaning in a name.
STOP_WORDS = "мм см м шт кг г л мл компл комплект набор ед пог кв куб п к и в с на для из по от до счет счете".split()
# Latin marks that are diameter markers or names of standards.
NO_MARKS = "dn du din iso en".split()
# Spellings of units and the one kept.
UNITS = {r"м\.п\.": "м", r"м\.пог\.": "м", r"пог\.м\.": "м", "пм": "м", "штук[аи]?": "шт", "комплект[аов]?": "компл"}
# Diameters written with Cyrillic markers, and their Latin form.
SIZES = {f"ду{n}": f"dn{n}" for n in (15, 20, 25, 32, 40, 50, 65, 80, 100)}
# How diameters, decimals and products of sizes are written, in the order in which they are read.
ENGINEERING = (
    (r"(\d),(\d)", "$1.$2"),
    ("[ø⌀]", " dn "),
    (rf"(^|{SPACE})ду\.?{SPACE}*(\d{{1,4}})(?:\.\d+)?(?={SPACE}|$)", " dn $2 "),
    (rf"(^|[^a-zа-я0-9])д[нп]\.?{SPACE}*=?{SPACE}*(\d{{1,4}})(?:\.\d+)?", "$1 dn $2 "),
    (rf"{_IN}dn\.?{SPACE}*(\d{{1,4}})(?:\.\d+)?{_OUT}", " dn $1 "),
    (rf"{_IN}d{SPACE}*={SPACE}*(\d{{1,4}})(?:\.\d+)?{_OUT}", " dn $1 "),
    (rf"{_IN}d{SPACE}*(\d{{1,4}})(?:\.\d+)?{_OUT}", " dn $1 "),
    (rf"(\d){SPACE}*[xх×*]{SPACE}*(\d)", "$1x$2"),
)
# Numbers of standards and of catalogues, which are no sizes.
NUMBERED = (
    r"(?iu)(^|[^a-zа-яё0-9])(?:гост|ост|ту|сто|снип|din|iso|en)[\s.№-]*\d[\d.\-/]*",
    r"(?iu)(^|[^a-zа-яё0-9])(?:артикул|каталог|арт|кат|код)[.:№\s-]*\d[\d.\-/]*",
)
# Token, what stands for it, the section it needs (if the section is known), one of which must stand beside it.
ALIASES: tuple[tuple[str, tuple[str, ...], str, tuple[str, ...]], ...] = (
    ("пуоц", ("воздуховод из тонколистовой оцинкованной стали", "воздуховод прямоугольный", "воздуховод оцинкованный", "пу оц"), "вентиляция", ("x", "b=", "т/м", "мм")),
    ("отводоц", ("отвод прямоугольного воздуховода", "отвод оц"), "вентиляция", ()),
    ("переходоц", ("переход прямоугольного сечения", "переход оц"), "вентиляция", ()),
    ("врезкаоц", ("врезка прямоугольная", "врезка оц"), "", ()),
    ("клапанппк", ("клапан противопожарный", "противопожарный клапан", "ppk", "ппк"), "", ()),
    ("отводкр", ("отвод круглого воздуховода",), "вентиляция", ("dn", "°", "гр")),
    ("решеткавент", ("решетка вентиляционная алюминиевая", "решетка вентиляционная", "решетка 1va", "1va"), "", ()),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replaced(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """``text`` after one rule (pattern, replacement) after the other."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def missing(text: Column) -> Column:
    """Empty text as null."""
    return F.nullif(text, F.lit(""))


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Whether one of the words stands in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _edged(word: str, pattern: str) -> str:
    """The pattern of a word between edges; an edge beside a letter that ASCII lacks needs an ASCII one outside."""
    ascii_ = re.compile("[A-Za-z0-9_]")
    bare = word.rstrip("?*+])") or word
    return (_IN if ascii_.match(word[0]) else _AFTER) + pattern + (_OUT if ascii_.match(bare[-1]) else _BEFORE)


def edged(word: str) -> str:
    """The pattern that finds a plain word between its edges."""
    ascii_ = re.compile("[A-Za-z0-9_]")
    return (_IN if ascii_.match(word[0]) else _AFTER) + re.escape(word) + (_OUT if ascii_.match(word[-1]) else _BEFORE)


def folded(text: Column, dictionary: Mapping[str, str]) -> Column:
    """Every word of a dictionary (plain text) replaced by what it stands for, in the dictionary's order."""
    return replaced(text, [("(?iu)" + edged(word), full.replace("\\", "\\\\").replace("$", "\\$")) for word, full in dictionary.items()])


def without_standards(text: Column) -> Column:
    """Bracketed references to standards removed, spaces collapsed."""
    return collapsed(F.regexp_replace(text, rf"(?iu)\([^)]*(?:ГОСТ|ТУ){SPACE}*[\d\s\-./]*[^)]*\)", " "))


def unit_words(text: Column) -> Column:
    """Unit spellings made one; their Cyrillic edges need ASCII neighbours to count as word edges."""
    return replaced(text, [("(?iu)" + _edged(p.replace("\\", ""), p), to) for p, to in UNITS.items()])


def engineering(text: Column) -> Column:
    """Lower case, one spelling for diameters, decimal points and size separators."""
    return replaced(F.translate(F.lower(text), "ё", "е"), ENGINEERING)


def with_aliases(text: Column, section: Column | None = None) -> Column:
    """A normalised (lower-case) text and the tokens of all groups that it speaks of; a null section asks for none."""
    def of(t: Column) -> Column:
        tokens = []
        for token, said, needs, beside in ALIASES:
            hit = any_of(t, said)
            if beside:
                hit = hit & any_of(t, beside)
            if needs and section is not None:
                hit = hit & ((F.coalesce(section, F.lit("")) == "") | F.startswith(F.lower(section), F.lit(needs)))
            tokens.append(F.when(hit, F.lit(token)))
        return F.concat_ws(" ", t, *tokens)

    return let(text, of)


def normalized(text: Column, section: Column | None = None, constructions: Mapping[str, str] | None = None, sizes: Mapping[str, str] = SIZES) -> Column:
    """A name for comparison: standards, units, sizes, synonyms, punctuation and stop words brought to one form, alias tokens added.

    ``constructions``: abbreviations and what they stand for, replaced in one pass, the longest where several fit.
    A null name gives the empty text.
    """
    s = folded(engineering(unit_words(without_standards(text))), sizes)
    if constructions:
        from larkspan.functions.synonyms import expanded

        s = expanded(s, constructions)
    s = collapsed(F.regexp_replace(F.lower(s), "[^\\p{L}\\p{N}\\s\\u00a0]", " "))
    return with_aliases(F.array_join(F.filter(F.split(s, " "), lambda w: (w != "") & ~w.isin(*STOP_WORDS)), " "), section)


def structural(text: Column) -> Column:
    """The text without bracketed standards, engineering spellings made one; a size "a на b" reads axb."""
    return F.regexp_replace(engineering(without_standards(text)), rf"(?iu)(\d){SPACE}*на{SPACE}*(\d)", "$1x$2")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What the pattern's group holds; null where it does not match or holds nothing."""
    return missing(F.regexp_extract(text, pattern, group))


def _dn(whole: Column) -> Column:
    return found(whole, rf"{_IN}dn[\s.\-/]*(\d{{1,4}})").cast("int")


def diameter(text: Column) -> Column:
    """The nominal diameter that a text names; null for none."""
    return _dn(structural(text))


def _whole_parts(text: Column, by: str) -> Column:
    """The whole numbers at the start of a text's parts; none for null."""
    return F.coalesce(F.transform(F.split(text, by), lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")), F.array().cast("array<int>"))


def cross_section(bare: Column) -> Column:
    """The first "axb" of a structural text, its numbers without idle zeros."""
    pattern = rf"{_IN}(\d{{1,4}})x(\d{{1,4}}(?:\.\d+)?){_OUT}"
    return let(bare, lambda t: F.concat(found(t, pattern, 1).cast("int").cast("string"), F.lit("x"), replaced(found(t, pattern, 2), [(r"(\.\d*?)0+$", "$1"), (r"\.$", ""), (r"^0+(?=\d)", "")])))


def marks(text: Column) -> Column:
    """Latin capitals that stand alone, as small letters, each once; diameter markers and standards left out."""
    alone = F.transform(F.regexp_extract_all(text, F.lit(rf"{_IN}([A-Z]{{1,3}}){_OUT}")), F.lower)
    return F.array_except(F.array_distinct(alone), F.array(*map(F.lit, NO_MARKS)))


def marking_features(text: Column) -> Column:
    """struct(dn, cross, config, marks, sizes): what tells one variant of an item from another."""
    def of(t: Column, whole: Column) -> Column:
        dn = _dn(whole)
        bare = replaced(whole, [(p, " ") for p in NUMBERED])
        return let(F.struct(dn.alias("dn"), bare.alias("bare")), lambda x: let(F.struct(x["dn"].alias("dn"), cross_section(x["bare"]).alias("cross"), found(x["bare"], rf"{_IN}(\d{{1,4}}-\d{{1,4}}(?:-\d{{1,4}})+){_OUT}").alias("config"), x["bare"].alias("bare")), lambda y: F.struct(y["dn"].alias("dn"), y["cross"].alias("cross"), y["config"].alias("config"), marks(t).alias("marks"), _sizes(y).alias("sizes"))))

    return let(text, lambda t: let(structural(t), lambda whole: of(t, whole)))


def _sizes(x: Column) -> Column:
    """The whole numbers of a text that its diameter, cross-section and configuration do not account for."""
    whole = F.transform(F.regexp_extract_all(F.regexp_replace(x["bare"], r"\d+\.\d+", " "), F.lit(rf"{_IN}(\d{{1,4}}){_OUT}")), lambda n: n.cast("int"))
    spoken_for = F.concat(F.when(x["dn"].isNotNull(), F.array(x["dn"])).otherwise(F.array().cast("array<int>")), _whole_parts(x["cross"], "x"), _whole_parts(x["config"], "-"))
    return F.array_except(F.array_distinct(whole), spoken_for)


def _said(features: Column, field: str) -> Column:
    """A strong feature as the list of its values; empty where the text does not say it."""
    return features[field] if field == "marks" else F.filter(F.array(features[field].cast("string")), lambda x: x.isNotNull())


def structural_score(spec: Column, offer: Column) -> Column:
    """-1 another variant, 1 the same, 0 unknown, from two marking_features structs.

    A strong feature that both name decides, a conflict before an agreement;
    then bare sizes; then a diameter that only the specification names.
    """
    verdicts = F.array(*[F.when((F.size(_said(spec, f)) > 0) & (F.size(_said(offer, f)) > 0), F.when(F.arrays_overlap(_said(spec, f), _said(offer, f)), 1).otherwise(-1)) for f in ("dn", "cross", "config", "marks")])
    sizes = F.when((F.size(spec["sizes"]) > 0) & (F.size(offer["sizes"]) > 0), F.when(F.arrays_overlap(spec["sizes"], offer["sizes"]), 1).otherwise(-1))
    numbers = F.concat(offer["sizes"], _whole_parts(offer["cross"], "x"))
    one_sided = F.when(spec["dn"].isNotNull() & offer["dn"].isNull(), F.when(F.coalesce(F.array_contains(numbers, spec["dn"]), F.lit(False)), 0).otherwise(-1))
    return F.coalesce(F.array_min(F.filter(verdicts, lambda v: v.isNotNull())), sizes, one_sided, F.lit(0))


def quantity_score(spec: Column, offer: Column) -> Column:
    """1 equal, 0 within five percent or unknown, -1 else."""
    gap = F.abs(spec - offer)
    known = spec.isNotNull() & offer.isNotNull() & (spec > 0) & (offer > 0)
    return F.when(~known | known.isNull(), 0).when(gap < 0.0001, 1).when(gap / F.greatest(spec, offer) <= 0.05, 0).otherwise(-1)


def entity_head(text: Column) -> Column:
    """The words before the first size, else the whole name, lower-cased."""
    head = rf"(?iu)^(.*?)(?:{SPACE}+(?:DN|Ду|d=|D=|du)?{SPACE}*\d|{SPACE}+\d{{2,}}[xX×/]|{SPACE}+\d+{SPACE}*(?:мм|mm))"
    return let(text, lambda t: F.lower(F.when(t.rlike(head), F.trim(F.regexp_extract(t, head, 1))).otherwise(t)))


def is_parameter(name: Column) -> Column:
    """Whether a name is a size or designation only, which needs its parent's name."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return n.rlike(rf"(?iu)^(δ|d|du|dn|ø|⌀){SPACE}*=?{SPACE}*\d{{1,4}}") | n.rlike(rf"(?iu)^\d{{2,4}}{SPACE}*[xх×]{SPACE}*\d{{2,4}}({SPACE}|$)") | n.rlike(r"(?iu)^[a-zа-я]{0,4}\d{2,4}[-xх×]\d{2,4}([-\s]\d{2,4})?$")


def code_prefix(name: Column) -> Column:
    """The product code that a name starts with: letters, digits, groups of digits."""
    return found(F.trim(name), r"^([A-Za-zА-Яа-я]{1,4}\s?\d{1,4}(?:[-_]\d{2,4}){1,3})")


def garbage_ratio(text: Column) -> Column:
    """Share of characters that no document should hold: replacement, control, private use and lone surrogate ones; an empty text counts as 1."""
    bad = F.regexp_count(text, F.lit("[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{E000}-\\x{F8FF}]"))
    pairs = 2 * F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))  # characters beyond the first plane are two surrogates
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(1.0)).otherwise((bad + pairs) / (F.length(text) + pairs / 2))


def tax_id_valid(inn: Column) -> Column:
    """Checksum of a ten- or twelve-digit tax number."""
    def digit(weights: list[int]) -> Column:
        total = F.lit(0)
        for i, w in enumerate(weights):
            total = total + F.substring(inn, i + 1, 1).try_cast("int") * w
        return total % 11 % 10

    ten, eleven = [2, 4, 10, 3, 5, 9, 4, 6, 8], [7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
    last = lambda k: F.substring(inn, k, 1).try_cast("int")
    return F.coalesce(
        F.when(inn.rlike(r"^\d{10}$"), digit(ten) == last(10)).when(inn.rlike(r"^\d{12}$"), (digit(eleven) == last(11)) & (digit([3, *eleven]) == last(12))), F.lit(False)
    )
