"""DuckDB expressions that say what the text functions do, for the queries' SQL."""

from __future__ import annotations

from larkspan.functions import names as N
from larkspan.functions import text as T


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(text: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return text


def collapsed(text: str) -> str:
    return f"trim({replaced(text, (r'\s+', ' '))})"


def engineering(text: str) -> str:
    return replaced(
        f"replace(lower({text}), 'ё', 'е')", (r"(\d),(\d)", r"\1.\2"), ("[ø⌀]", " dn "), (r"(^|\s)ду\.?\s*(\d{1,4})(?:\.\d+)?(\s|$)", r" dn \2 \3"), (r"(^|[^a-zа-я0-9])д[нп]\.?\s*=?\s*(\d{1,4})(?:\.\d+)?", r"\1 dn \2 "),
        (r"\bdn\.?\s*(\d{1,4})(?:\.\d+)?\b", r" dn \1 "), (r"\bd\s*=\s*(\d{1,4})(?:\.\d+)?\b", r" dn \1 "), (r"\bd\s*(\d{1,4})(?:\.\d+)?\b", r" dn \1 "), (r"(\d)\s*[xх×*]\s*(\d)", r"\1x\2"),
    )


def without_standards(text: str) -> str:
    return collapsed(replaced(text, (r"(?i)\([^)]*(?:ГОСТ|ТУ)\s*[\d\s\-./]*[^)]*\)", " ")))


def structural(text: str) -> str:
    return replaced(engineering(without_standards(text)), (r"(?i)(\d)\s*на\s*(\d)", r"\1x\2"))


def any_of(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def plain(text: str) -> str:
    """``normalized`` before the alias tokens; size synonyms need neighbours that names do not have."""
    words = collapsed(replaced(f"lower({engineering(without_standards(text))})", (r"[^\p{L}\p{N}\s]", " ")))
    return f"array_to_string(list_filter(string_split({words}, ' '), lambda w: w <> '' AND NOT list_contains([{', '.join(map(quoted, T.STOP_WORDS))}], w)), ' ')"


def with_aliases(text: str, section: str) -> str:
    added = []
    for token, said, needs, beside in T.ALIASES:
        gate = any_of(text, said) + (f" AND {any_of(text, beside)}" if beside else "") + (f" AND (coalesce({section}, '') = '' OR starts_with(lower({section}), {quoted(needs)}))" if needs else "")
        added.append(f"CASE WHEN {gate} THEN ' {token}' ELSE '' END")
    return f"{text} || {' || '.join(added)}"


def section_of(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(f'lower({text})', stems)} THEN {quoted(section)}" for section, stems in N.SECTIONS.items()) + " END"


def found(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, {group}), '')"


def dice(a: str, b: str) -> str:
    """Dice of two texts without white space, as a scalar over lists of bigrams with their counts."""
    g = lambda t: f"list_transform(range(1, greatest(length({t}), 1)), lambda i: substr({t}, CAST(i AS BIGINT), 2))"
    shared = f"list_sum(list_transform(list_distinct({g(a)}), lambda x: least(len(list_filter({g(a)}, lambda y: y = x)), len(list_filter({g(b)}, lambda y: y = x)))))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * coalesce({shared}, 0) / (length({a}) + length({b}) - 2) END"
