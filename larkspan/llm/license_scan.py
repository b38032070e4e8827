"""Licence scans: ordered signature rules behind keywords, overlaps resolved by level and containment.

DataFrame and SQL functions only.  A text becomes its words in small letters,
one space apart.  Most texts end at one pattern over all keywords; the others
are searched by the rules whose keyword they hold.  Of two detections, one
inside the other, the less important one goes.  A row needs no other row, so
nothing moves between tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import let
from larkspan.llm.license_rules import RULES, WORTH, Rule
from larkspan.llm.resampling import BETWEEN, lower_ascii

# Phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: What a place of a phrase is worth for the score.
PHRASE_WORTH = 0.6
#: Detections of a text that are compared one by one; runs of them meet by the extremes of each level.
BLOCK = 256
_FOUND = "array<struct<start: bigint, last: bigint, level: int, rule: int, end: bigint, label: string>>"


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _blocks(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))


def _running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` has made of the values before each one."""
    state = F.struct(start.alias("now"), F.slice(F.array(start), F.lit(1), F.lit(0)).alias("out"))
    return F.aggregate(values, state, lambda s, x: F.struct(step(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])


def _sums_before(steps: Column) -> Column:
    """The sum of the numbers before each one; in blocks, so that many of them do not cost their square."""
    zero, add = F.lit(0).cast("long"), lambda a, b: a + b
    with_base = lambda blocks: F.struct(blocks.alias("blocks"), _running(F.transform(blocks, lambda b: F.aggregate(b, zero, add)), zero, add).alias("base"))
    return let(_blocks(steps), lambda blocks: let(with_base(blocks), lambda t: F.flatten(F.transform(t["blocks"], lambda b, i: F.transform(_running(b, zero, add), lambda x: x + t["base"][i])))))


def _places(words: Column, rule: Column) -> Column:
    """Detections of one rule: first word, end word, level and label."""
    cut = F.struct(F.regexp_extract_all(words, rule["pattern"], F.lit(0)).alias("found"), F.split(words, rule["pattern"], -1).alias("gaps"))

    def spans(c: Column) -> Column:
        held, between = F.transform(c["found"], _spaces), F.transform(c["gaps"], _spaces)
        return let(F.struct(held.alias("held"), between.alias("between")), lambda n: let(
            F.struct(n["held"].alias("held"), n["between"].alias("between"), _sums_before(F.transform(n["held"], lambda h, i: h + n["between"][i])).alias("before")),
            lambda n: F.transform(n["held"], lambda h, i: _detection(n["before"][i] + n["between"][i] - 1, h + 1, rule)),
        ))

    return let(cut, spans)


def _detection(start: Column, size: Column, rule: Column) -> Column:
    # Ordered by start, the longer one first, then by level and rule.
    return F.struct(start.alias("start"), (-(start + size)).alias("last"), rule["level"].alias("level"), rule["number"].alias("rule"), (start + size).alias("end"), rule["label"].alias("label"))


def _resolved(found: Column) -> Column:
    """Without detections inside another one of their level or a more important one, and without those that hold a more important one.

    ``found`` is in order, so what holds a detection stands before it and what
    it holds behind it: within a block one by one, beyond it by the farthest end
    of each level before and the nearest end of each level behind.
    """
    levels = F.array(*[F.lit(i) for i in range(1, len(WORTH) + 1)])
    none, all_ = (F.transform(levels, lambda _: F.lit(x).cast("long")) for x in (-1, 2**62))
    farthest = lambda b: F.transform(levels, lambda v: F.coalesce(F.array_max(F.transform(F.filter(b, lambda d: d["level"] <= v), lambda d: d["end"])), F.lit(-1).cast("long")))
    nearest = lambda b: F.transform(levels, lambda v: F.coalesce(F.array_min(F.transform(F.filter(b, lambda d: d["level"] < v), lambda d: d["end"])), F.lit(2**62)))
    before = lambda blocks: _running(F.transform(blocks, farthest), none, lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    behind = lambda blocks: F.reverse(_running(F.reverse(F.transform(blocks, nearest)), all_, lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))))

    def stays(t: Column, block: Column, k: Column) -> Column:
        def gone(d: Column, i: Column) -> Column:
            inside = (t["before"][k][d["level"] - 1] >= d["end"]) | F.exists(F.slice(block, F.lit(1), i), lambda e: (e["level"] <= d["level"]) & (e["end"] >= d["end"]))
            holds = (t["behind"][k][d["level"] - 1] <= d["end"]) | F.exists(F.slice(block, i + 2, F.lit(BLOCK)), lambda e: (e["level"] < d["level"]) & (e["end"] <= d["end"]))
            return inside | holds

        return F.filter(block, lambda d, i: ~gone(d, i))

    known = lambda blocks: F.struct(blocks.alias("blocks"), before(blocks).alias("before"), behind(blocks).alias("behind"))
    return let(_blocks(found), lambda blocks: let(known(blocks), lambda t: F.flatten(F.transform(t["blocks"], lambda b, k: stays(t, b, k)))))


def _literal(rules: Sequence[Rule]) -> Column:
    """The rules by keyword, as one constant."""
    text = lambda s: "r'" + s.replace("'", "") + "'"  # noqa: E731  patterns hold words, none of which has a quote
    sets = []
    for keyword, some in groupby(sorted(rules, key=lambda r: (r.keyword, r.number)), key=lambda r: r.keyword):
        inner = ", ".join(f"named_struct('number', {r.number}, 'level', {r.level}, 'label', {text(r.label)}, 'pattern', {text(f'(?<= )(?:{r.pattern})(?= )')})" for r in some)
        sets.append(f"named_struct('keyword', {text(' ' + keyword)}, 'rules', array({inner}))")
    return F.expr(f"array({', '.join(sets)})")


def any_keyword(keywords: Sequence[str]) -> str:
    """One pattern that finds any of the keywords at the start of a word; keywords that begin alike share a branch."""
    shortest = [k for k in sorted(set(keywords)) if not any(k != s and k.startswith(s) for s in keywords)]
    branches = [f"{letter}(?:{'|'.join(k[1:] for k in some)})" for letter, some in groupby(shortest, key=lambda k: k[0])]
    return f" (?:{'|'.join(branches)})"


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) of every document.

    ``n_base`` places where a phrase's words stand one after the other, the
    first words of the first and the last of them (null without any) and the
    phrases' labels; ``labels`` has these and the rules' own, ``found`` the
    rules' detections that are left (start, end behind the last word, level,
    rule, label; words from 0).  ``score`` is 1 less the product of the doubts
    that each detection, and the phrases together, leave.

    A null or empty text has no words, no labels (empty strings) and score 0.  A
    null id stays null; rows that repeat an id or a text are scanned each.
    Detections of one place and level count by the order of the rules.  A text
    of any length is scanned whole, within its row.  An empty table gives an
    empty one.  Other columns are ignored.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), BETWEEN, " "))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("plain"))
    rows = rows.withColumn("n_words", F.when(F.col("plain") == "", F.lit(0).cast("long")).otherwise(_spaces(F.col("plain")) + 1))
    asked = any_keyword([r.keyword for r in rules] + [p.split()[0] for p in phrases])
    # Letters outside A-Z can only add to what this finds; what follows is exact.
    rows = rows.withColumn("words", F.when(F.concat(F.lit(" "), F.lower("plain")).rlike(asked), F.concat(F.lit(" "), lower_ascii(F.col("plain")), F.lit(" ")))).drop("plain")

    words = F.col("words")
    gaps = [F.when(F.contains(words, F.lit(f" {p} ")), F.split(words, f"(?<= )(?={re.escape(p)} )", -1)) for p in phrases]
    rows = rows.withColumn("gaps", F.when(words.isNotNull(), F.array(*gaps)))
    one = F.transform("gaps", lambda g: F.when(g.isNotNull(), F.struct((F.size(g) - 1).cast("long").alias("n"), (_spaces(g[0]) - 1).alias("first"), (_spaces(words) - _spaces(F.element_at(g, -1)) - 1).alias("last"))))
    rows = rows.withColumn("base", one).drop("gaps")
    part = lambda name: F.transform("base", lambda b: b[name])
    named = F.filter(F.transform(F.array(*map(F.lit, phrases.values())), lambda v, i: F.when(F.col("base")[i].isNotNull(), v)), lambda v: v.isNotNull())

    held = F.filter(_literal(rules), lambda k: F.contains(words, k["keyword"]))
    some = F.flatten(F.transform(held, lambda k: F.filter(k["rules"], lambda r: F.rlike(words, r["pattern"]))))
    rows = rows.withColumn("all", F.when(words.isNotNull(), F.array_sort(F.flatten(F.transform(some, lambda r: _places(words, r))))))
    rows = rows.withColumn("left", F.coalesce(F.when(F.size("all") > 0, _resolved(F.col("all"))), F.array().cast(_FOUND))).drop("all", "words")
    rows = rows.withColumn("base_labels", F.coalesce(F.array_sort(F.array_distinct(named)), F.array().cast("array<string>")))
    doubts = F.array(*[F.lit(round(1 - w, 6)) for w in WORTH])
    doubt = F.aggregate("left", F.when(F.size("base_labels") > 0, F.lit(1 - PHRASE_WORTH)).otherwise(F.lit(1.0)), lambda s, d: s * doubts[d["level"] - 1])
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.aggregate(part("n"), F.lit(0).cast("long"), lambda s, n: s + F.coalesce(n, F.lit(0).cast("long"))), F.lit(0).cast("long")).alias("n_base"),
        F.array_min(part("first")).alias("first_word"), F.array_max(part("last")).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", F.transform("left", lambda d: d["label"]))), ",").alias("labels"), F.round(1 - doubt, 6).alias("score"),
        F.transform("left", lambda d: F.struct(d["start"], d["end"], d["level"], d["rule"], d["label"])).alias("found"),
    )
