"""Names, units, numbers and sections as queries, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import names as N
from larkspan.functions import numbers as U
from larkspan.functions import text as T
from larkspan.operators import match as X
from larkspan.operators.similarity import dice_join, token_overlap_top
from larkspan.operators import synonyms as Y
from larkspan.plans import oracle as O
from larkspan.plans.registry import query
from larkspan.sources import adapters as A


def _round(x: F.Column) -> F.Column:
    return F.floor(x * 1000 + 0.5) / 1000


# --- normalisation and features -----------------------------------------------

_TEXT = f", t AS (SELECT *, {O.plain('name')} AS plain FROM named)"


@query("named", _TEXT + f" SELECT spec_id, {O.with_aliases('plain', 'section')} AS normalized FROM t")
def domain_alias_append(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("spec_id", T.normalized(F.col("name"), F.col("section")).alias("normalized"))


@query("named", f" SELECT spec_id, CAST({O.found(O.structural('name'), r'\bdn[\s.\-/]*(\d{1,4})')} AS INT) AS dn FROM named")
def dn_values(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("spec_id", T.diameter(F.col("name")).alias("dn"))


_BARE = O.replaced(O.structural("name"), (r"(?i)(^|[^a-zа-яё0-9])(?:гост|ост|ту|сто|снип|din|iso|en)[\s.№-]*\d[\d.\-/]*", " "), (r"(?i)(^|[^a-zа-яё0-9])(?:артикул|каталог|арт|кат|код)[.:№\s-]*\d[\d.\-/]*", " "))
_CROSS = r"\b(\d{1,4})x(\d{1,4}(?:\.\d+)?)\b"
_FEATURES = f""", b AS (SELECT spec_id, name, {O.structural('name')} AS whole, {_BARE} AS bare FROM named),
 c AS (SELECT spec_id, CAST({O.found('whole', r'\bdn[\s.\-/]*(\d{1,4})')} AS INT) AS dn,
  CAST(CAST({O.found('bare', _CROSS)} AS INT) AS VARCHAR) || 'x' || regexp_replace(regexp_replace(regexp_replace({O.found('bare', _CROSS, 2)}, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '^0+(\\d)', '\\1') AS cross_size,
  {O.found('bare', r'\b(\d{1,4}-\d{1,4}(?:-\d{1,4})+)\b')} AS config,
  list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(name, '\\b([A-Z]{{1,3}})\\b', 1), lambda m: lower(m))), lambda m: m NOT IN ('dn', 'du', 'din', 'iso', 'en'))) AS marks,
  list_distinct(list_transform(regexp_extract_all(regexp_replace(bare, '\\d+\\.\\d+', ' ', 'g'), '\\b(\\d{{1,4}})\\b', 1), lambda n: CAST(n AS INT))) AS ints FROM b),
 f AS (SELECT *, list_sort(list_filter(ints, lambda n: NOT coalesce(n = dn, false) AND NOT list_contains(list_transform(string_split(coalesce(cross_size, ''), 'x'), lambda p: TRY_CAST(regexp_extract(p, '^(\\d+)', 1) AS INT)), n)
  AND NOT list_contains(list_transform(string_split(coalesce(config, ''), '-'), lambda p: TRY_CAST(p AS INT)), n))) AS sizes FROM c)"""


@query("named", _FEATURES + " SELECT spec_id, dn, cross_size, config, array_to_string(marks, ' ') AS marks, array_to_string(sizes, ' ') AS sizes FROM f")
def marking_features(spark: SparkSession, d: str) -> DataFrame:
    t = A.named(spark, d).select("spec_id", T.marking_features(F.col("name")).alias("m"))
    return t.select("spec_id", "m.dn", F.col("m.cross").alias("cross_size"), "m.config", F.array_join(F.sort_array("m.marks"), " ").alias("marks"), F.array_join(F.sort_array("m.sizes"), " ").alias("sizes"))


@query("named", _FEATURES + """
, p AS (SELECT a.spec_id, b.spec_id AS other_id, a.dn AS d1, b.dn AS d2, a.cross_size AS c1, b.cross_size AS c2, a.config AS g1, b.config AS g2, a.marks AS m1, b.marks AS m2, a.sizes AS s1, b.sizes AS s2 FROM f a JOIN f b ON b.spec_id IN (a.spec_id + 12, a.spec_id + 1))
 SELECT spec_id, other_id, CASE WHEN coalesce(d1 <> d2, false) OR coalesce(c1 <> c2, false) OR coalesce(g1 <> g2, false) OR (len(m1) > 0 AND len(m2) > 0 AND NOT list_has_any(m1, m2)) THEN -1
  WHEN coalesce(d1 = d2, false) OR coalesce(c1 = c2, false) OR coalesce(g1 = g2, false) OR list_has_any(m1, m2) THEN 1
  WHEN len(s1) > 0 AND len(s2) > 0 THEN CASE WHEN list_has_any(s1, s2) THEN 1 ELSE -1 END
  WHEN d1 IS NOT NULL AND d2 IS NULL THEN CASE WHEN list_contains(s2, d1) OR coalesce(list_contains(list_transform(string_split(c2, 'x'), lambda p: TRY_CAST(regexp_extract(p, '^(\\d+)', 1) AS INT)), d1), false) THEN 0 ELSE -1 END ELSE 0 END AS score FROM p""")
def structural_score(spark: SparkSession, d: str) -> DataFrame:
    t = A.named(spark, d).select("spec_id", T.marking_features(F.col("name")).alias("m"))
    near = t.select("spec_id", F.col("m").alias("m1"), F.explode(F.array(F.col("spec_id") + 12, F.col("spec_id") + 1)).alias("other_id"))
    return near.join(t.select(F.col("spec_id").alias("other_id"), F.col("m").alias("m2")), "other_id").select("spec_id", "other_id", T.structural_score(F.col("m1"), F.col("m2")).alias("score"))


@query("named", f" SELECT spec_id, {O.found('trim(name)', r'^([A-Za-zА-Яа-я]{1,4}\s?\d{1,4}(?:[-_]\d{2,4}){1,3})')} AS code, lower({O.found('name', r'^([^0-9]+?)\s+(?:DN|Ду)?\s*\d')}) AS head FROM named WHERE spec_id % 12 IN (0, 1, 4)")
def code_prefix(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("name").rlike(r"^[^0-9]+?\s+(?:DN|Ду)?\s*\d"), T.entity_head(F.col("name")))
    return A.named(spark, d).where("spec_id % 12 IN (0, 1, 4)").select("spec_id", T.code_prefix(F.col("name")).alias("code"), head.alias("head"))


_PARAMETER = r"(regexp_matches(name, '(?i)^(δ|d|du|dn|ø|⌀)\s*=?\s*\d{1,4}') OR regexp_matches(name, '(?i)^\d{2,4}\s*[xх×]\s*\d{2,4}(\s|$)') OR regexp_matches(name, '(?i)^[a-zа-я]{0,4}\d{2,4}[-xх×]\d{2,4}([-\s]\d{2,4})?$'))"
_PARENTS = f""", q AS (SELECT *, {_PARAMETER} AS parameter, lower(trim(coalesce(position_number, ''))) AS pos FROM named),
 w AS (SELECT *, last_value(CASE WHEN NOT parameter THEN name END IGNORE NULLS) OVER (PARTITION BY sheet, pos ORDER BY spec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM q)"""


@query("named", _PARENTS + " SELECT spec_id, parameter, CASE WHEN pos <> '' AND parameter AND parent IS NOT NULL THEN trim(parent || ' ' || name) ELSE name END AS base FROM w")
def parent_names(spark: SparkSession, d: str) -> DataFrame:
    t = A.named(spark, d).withColumnRenamed("spec_id", "id").withColumn("full_name", F.lit(None).cast("string"))
    return X.with_parents(t).select(F.col("id").alias("spec_id"), T.is_parameter(F.col("name")).alias("parameter"), "base")


_DN = O.found(O.structural("base"), r"\bdn[\s.\-/]*(\d{1,4})")


@query("named", _PARENTS + f""", k AS (SELECT spec_id, CASE WHEN pos <> '' AND parameter AND parent IS NOT NULL THEN trim(parent || ' ' || name) ELSE name END AS base FROM w),
 n AS (SELECT spec_id, {O.plain('base')} AS plain, {_DN} AS dn FROM k), g AS (SELECT spec_id, {O.with_aliases('plain', 'NULL')} || '|DN' || coalesce(dn, '') AS key FROM n)
 SELECT spec_id, CAST(count(*) OVER w AS BIGINT) AS size, min(spec_id) OVER w AS leader, CASE WHEN spec_id = min(spec_id) OVER w THEN 'leader' ELSE 'follower' END AS role FROM g WINDOW w AS (PARTITION BY key) QUALIFY count(*) OVER w >= 2""")
def dup_leader_role(spark: SparkSession, d: str) -> DataFrame:
    t = X.with_parents(A.named(spark, d).withColumnRenamed("spec_id", "id").withColumn("full_name", F.lit(None).cast("string")))
    key = F.concat(T.normalized(F.col("base")), F.lit("|DN"), F.coalesce(T.diameter(F.col("base")).cast("string"), F.lit("")))
    t = t.select(F.col("id").alias("spec_id"), key.alias("key"))
    g = t.groupBy("key").agg(F.count("*").alias("size"), F.min("spec_id").alias("leader")).where("size >= 2")
    return t.join(g, "key").select("spec_id", "size", "leader", F.when(F.expr("spec_id = leader"), "leader").otherwise("follower").alias("role"))


# --- sections and quality ------------------------------------------------------


@query("named", f" SELECT spec_id, {O.section_of('name')} AS found FROM named")
def section_by_keywords(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("spec_id", N.section_of(F.col("name")).alias("found"))


@query("named", f""", s AS (SELECT sheet, spec_id, {O.section_of('name')} AS found FROM named), v AS (SELECT sheet, found, count(*) AS votes, min(spec_id) AS first_id FROM s WHERE found IS NOT NULL GROUP BY ALL)
 SELECT sheet, arg_min(found, struct_pack(a := -votes, b := first_id)) AS section, CAST(max(votes) AS BIGINT) AS votes FROM v GROUP BY sheet""")
def section_majority_vote(spark: SparkSession, d: str) -> DataFrame:
    s = A.named(spark, d).select("sheet", "spec_id", N.section_of(F.col("name")).alias("found")).where("found IS NOT NULL")
    votes = s.groupBy("sheet", "found").agg(F.count("*").alias("votes"), F.min("spec_id").alias("first_id"))
    return votes.groupBy("sheet").agg(F.min_by("found", F.struct(-F.col("votes"), F.col("first_id"))).alias("section"), F.max("votes").alias("votes"))


_ANCHOR = "[Ѐ-ФЦ-фц-ӿ]"
_SANDWICH = f"regexp_matches(name, '{_ANCHOR}[0-9A-Za-zЀ-ӿ]*[0-9A-Za-z][0-9A-Za-zЀ-ӿ]*{_ANCHOR}')"
_WEDGE = f"regexp_matches(name, '{_ANCHOR}[0-9A-Za-zЀ-ӿ]*[A-Za-z][0-9A-Za-zЀ-ӿ]*{_ANCHOR}')"


@query("named", f" SELECT spec_id, {_SANDWICH} AS sandwich, {_WEDGE} AS latin_wedge FROM named")
def script_corruption(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("spec_id", N.script_corruption(F.col("name")).alias("x")).select("spec_id", "x.*")


@query("named", f""" SELECT sheet, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER ({_SANDWICH}) AS BIGINT) AS flagged, floor(count(*) FILTER ({_SANDWICH}) * 1000.0 / count(*) + 0.5) / 1000 AS ratio,
 count(*) FILTER ({_SANDWICH}) * 2 >= count(*) AS suspicious, array_to_string(list_sort(list(spec_id) FILTER ({_WEDGE})), ' ') AS wedge_rows FROM named GROUP BY sheet""")
def name_corruption_by_sheet(spark: SparkSession, d: str) -> DataFrame:
    t = A.named(spark, d).select("sheet", "spec_id", N.script_corruption(F.col("name")).alias("x"))
    g = t.groupBy("sheet").agg(F.count("*").alias("total"), F.count(F.when(F.col("x.sandwich"), 1)).alias("flagged"), F.sort_array(F.collect_list(F.when(F.col("x.latin_wedge"), F.col("spec_id")))).alias("rows"))
    return g.select("sheet", "total", "flagged", _round(F.col("flagged") / F.col("total")).alias("ratio"), (F.col("flagged") * 2 >= F.col("total")).alias("suspicious"), F.nullif(F.array_join("rows", " "), F.lit("")).alias("wedge_rows"))


_FRAGMENT = r"""(regexp_matches(name, '(?i)^то\s+же') OR length(name) <= 12 OR (length(name) <= 28 AND (regexp_matches(name, '(?i)^(dn|ду|дн|d|ø|⌀|pn|ру|f|ф)\s*=?\s*[ø⌀]?\s*\d') OR regexp_matches(name, '(?i)^[a-zа-яё]{0,4}\d[\d\s.,xх×*/_+-]*$'))))"""


@query("named", f""", r AS (SELECT *, position_number IS NULL AS nopos, {_FRAGMENT} AS bare FROM named),
 g AS (SELECT sheet, count(*) AS n, avg(CAST(nopos AS INT)) AS no_position, avg(CAST(nopos AND bare AS INT)) AS bare_orphans, avg(CAST(quantity IS NULL AS INT)) AS no_quantity, avg(CAST(coalesce(regexp_matches(position_number, '^\\d{{1,4}}$'), false) AS INT)) AS position_as_quantity FROM r GROUP BY sheet)
 SELECT sheet, CAST(n AS BIGINT) AS n, floor(no_position * 1000 + 0.5) / 1000 AS no_position, floor(bare_orphans * 1000 + 0.5) / 1000 AS bare_orphans, floor(no_quantity * 1000 + 0.5) / 1000 AS no_quantity, floor(position_as_quantity * 1000 + 0.5) / 1000 AS position_as_quantity,
  n >= 5 AND (bare_orphans > 0.5 OR (no_quantity >= 0.9 AND position_as_quantity >= 0.5)) AS hard_block FROM g""")
def spec_parse_quality(spark: SparkSession, d: str) -> DataFrame:
    """Shares of rows without a position, of fragments without one, without a quantity, with a quantity in the position; the verdict."""
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("int"))
    nopos, bare = F.col("position_number").isNull(), N.is_bare_fragment(F.col("name"))
    g = A.named(spark, d).groupBy("sheet").agg(F.count("*").alias("n"), share(nopos).alias("a"), share(nopos & bare).alias("b"), share(F.col("quantity").isNull()).alias("c"), share(F.col("position_number").rlike(r"^\d{1,4}$")).alias("e"))
    block = (F.col("n") >= 5) & ((F.col("b") > 0.5) | ((F.col("c") >= 0.9) & (F.col("e") >= 0.5)))
    return g.select("sheet", "n", _round(F.col("a")).alias("no_position"), _round(F.col("b")).alias("bare_orphans"), _round(F.col("c")).alias("no_quantity"), _round(F.col("e")).alias("position_as_quantity"), block.alias("hard_block"))


@query("named", """, p AS (SELECT sheet, CAST(position_number AS BIGINT) AS n FROM named WHERE regexp_matches(position_number, '^[0-9]+$'))
 SELECT sheet, CAST(count(*) AS BIGINT) AS rows_n, count(*) > count(DISTINCT n) AS repeated, count(*) < max(n) - min(n) + 1 AS gaps FROM p GROUP BY sheet""")
def position_sequence(spark: SparkSession, d: str) -> DataFrame:
    p = A.named(spark, d).select("sheet", F.when(F.col("position_number").rlike("^[0-9]+$"), F.col("position_number").cast("long")).alias("n")).where("n IS NOT NULL")
    return p.groupBy("sheet").agg(F.count("*").alias("rows_n"), (F.count("*") > F.countDistinct("n")).alias("repeated"), (F.count("*") < F.max("n") - F.min("n") + 1).alias("gaps"))


_GARBAGE = r"length(text) - length(regexp_replace(text, '[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x{E000}-\x{F8FF}]', '', 'g'))"


@query("", f"SELECT doc_id, floor(CASE WHEN length(text) > 0 THEN ({_GARBAGE}) / CAST(length(text) AS DOUBLE) ELSE 1.0 END * 1000 + 0.5) / 1000 AS ratio, CASE WHEN length(text) > 0 THEN ({_GARBAGE}) / CAST(length(text) AS DOUBLE) ELSE 1.0 END > 0.1 AS garbled FROM documents")
def garbage_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = A.read(spark, d, "documents").select("doc_id", T.garbage_ratio(F.col("text")).alias("r"))
    return t.select("doc_id", _round(F.col("r")).alias("ratio"), (F.col("r") > 0.1).alias("garbled"))


# --- variants, fragments, units -------------------------------------------------


@query("named", r""", m AS (SELECT spec_id, name, regexp_extract(name, '(Q=\d+ Вт)(\s|$)', 1) AS q, regexp_extract(name, '(Левое исполнение)', 1) AS e FROM named)
 SELECT spec_id, CASE WHEN q <> '' THEN trim(regexp_replace(regexp_replace(name, '\s(Q=\d+ Вт)', ' '), '\s*(Левое исполнение)', '')) ELSE name END AS clean, nullif(concat_ws('; ', nullif(q, ''), nullif(e, '')), '') AS characteristics FROM m""")
def variant_marks(spark: SparkSession, d: str) -> DataFrame:
    t = A.named(spark, d).select("spec_id", N.variant_marks(F.col("name")).alias("v"))
    return t.select("spec_id", "v.clean", N.merged_characteristics(F.lit(None).cast("string"), F.col("v.marks")).alias("characteristics"))


@query("named", r""", p AS (SELECT spec_id, quantity, CASE WHEN len(regexp_extract_all(name, '[+;•]')) >= 2 THEN list_filter(list_transform(regexp_split_to_array(name, '[+;•]'), lambda x: regexp_replace(trim(x), '^[-–—]\s*', '')), lambda x: length(x) >= 3) ELSE [name] END AS parts FROM named)
 SELECT spec_id, CAST(i - 1 AS INT) AS part, parts[i] AS name, CASE WHEN i = 1 THEN quantity END AS quantity FROM p, unnest(range(1, len(parts) + 1)) u(i)""")
def split_product_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row a product; the quantity stays with the first one."""
    t = A.named(spark, d).select("spec_id", "quantity", F.posexplode(N.split_products(F.col("name"))).alias("part", "name"))
    return t.select("spec_id", "part", "name", F.when(F.col("part") == 0, F.col("quantity")).alias("quantity"))


@query("named", r""", u AS (SELECT spec_id, unit, lower(regexp_replace(trim(coalesce(unit, '')), '[.\s]+', '', 'g')) AS k FROM named)
 SELECT spec_id, CASE WHEN k IN ('м', 'm', 'sm') THEN 'м' WHEN k IN ('шт', 'штука', 'pcs', 'pc', 'st') THEN 'шт' WHEN k IN ('уп', 'упак', 'упаковка') THEN 'уп' WHEN k IN ('кор', 'коробка') THEN 'кор' WHEN k IN ('компл', 'комплект', 'к-т') THEN 'компл' ELSE k END AS unit FROM u""")
def canonical_units(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("spec_id", N.canonical_unit(F.col("unit")).alias("unit"))


@query("named", r" SELECT spec_id, trim(regexp_replace(replace(lower(name), 'ё', 'е'), '[^\p{L}\p{N}]+', ' ', 'g')) AS name_key, trim(regexp_replace(regexp_replace(replace(lower(name), 'ё', 'е'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS header FROM named")
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("spec_id", N.name_key(F.col("name")).alias("name_key"), N.header_cell(F.col("name")).alias("header"))


@query("named", r""", x AS (SELECT spec_id, CASE WHEN spec_id % 2 = 0 THEN name ELSE sheet END AS article, CASE WHEN spec_id % 2 = 0 THEN sheet ELSE name END AS name FROM named), s AS (SELECT *, (length(article) > 30 OR regexp_matches(article, '[а-яёА-ЯЁ]{11,}')) AND NOT (length(name) > 30 OR regexp_matches(name, '[а-яёА-ЯЁ]{11,}')) AS swap FROM x)
 SELECT spec_id, CASE WHEN swap THEN name ELSE article END AS article, CASE WHEN swap THEN article ELSE name END AS name FROM s""")
def swapped_articles(spark: SparkSession, d: str) -> DataFrame:
    t = A.named(spark, d).selectExpr("spec_id", "CASE WHEN spec_id % 2 = 0 THEN name ELSE sheet END AS article", "CASE WHEN spec_id % 2 = 0 THEN sheet ELSE name END AS name")
    return t.select("spec_id", N.swapped_article(F.col("article"), F.col("name")).alias("x")).select("spec_id", "x.*")


@query("named", r""", w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(regexp_replace(replace(lower(name), 'ё', 'е'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS t FROM named)
 SELECT a.t AS short, b.t AS long FROM w a JOIN w b ON substr(a.t, 1, 1) = substr(b.t, 1, 1) WHERE NOT regexp_matches(a.t, '^[0-9]') AND length(a.t) BETWEEN 2 AND 4 AND length(b.t) >= length(a.t) + 3
  AND len(list_filter(string_split(substr(a.t, 2), ''), lambda c: NOT contains(b.t, c))) = 0""")
def abbreviation_pairs(spark: SparkSession, d: str) -> DataFrame:
    words = A.named(spark, d).select(F.explode(F.split(N.header_cell(F.col("name")), " ")).alias("t")).distinct().withColumn("k", F.substring("t", 1, 1))
    short = words.where("length(t) BETWEEN 2 AND 4").select("k", F.col("t").alias("short"))
    return short.join(words.where("length(t) >= 5").select("k", F.col("t").alias("long")), "k").where(N.abbreviates(F.col("short"), F.col("long"))).select("short", "long")


_ABBREVIATED = "concat(name, CASE spec_id % 5 WHEN 0 THEN ' нг-LS' WHEN 1 THEN ' lsltx' WHEN 2 THEN ' LSX ls' WHEN 3 THEN '' ELSE ' ls-ls' END)"


@query("named", f""", a AS (SELECT spec_id, section, {_ABBREVIATED} AS name FROM named), r AS (SELECT spec_id, section, regexp_replace(regexp_replace({O.engineering(O.without_standards('name'))}, '\\blsltx\\b', 'низкое дымовыделение', 'gi'), '\\bls\\b', 'низкое дымовыделение', 'gi') AS name FROM a),
 t AS (SELECT *, {O.plain('name')} AS plain FROM r) SELECT spec_id, {O.with_aliases('plain', 'section')} AS normalized FROM t""")
def normalize_with_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Names with abbreviations of the whole first dictionary, which comes as a table; of its words only Latin ones stand by themselves."""
    names = A.named(spark, d).select("spec_id", "section", F.expr(_ABBREVIATED).alias("name"))
    return names.select("spec_id", T.normalized(F.col("name"), F.col("section"), Y.as_mapping(Y.seed(spark))).alias("normalized"))


_PAIRS = "SELECT spec_id, CASE spec_id % 4 WHEN 0 THEN concat('пп труба ', CAST(p_size AS STRING)) WHEN 1 THEN 'кш муфтовый' WHEN 2 THEN 'труба ls' ELSE name END AS spec, CASE spec_id % 4 WHEN 0 THEN concat('труба полипропилен', CAST(p_size AS STRING)) WHEN 1 THEN concat('краншаровой', CAST(p_size % 9 AS STRING), ' муфтовый') WHEN 2 THEN 'труба дымовыделение' ELSE name END AS offer, CAST(80 + p_size % 20 AS DOUBLE) / 100 AS confidence FROM"


@query("specs", f""", p AS ({_PAIRS} specs), s AS (SELECT string_split(lower(spec), ' ') AS x, string_split(lower(offer), ' ') AS y FROM p WHERE confidence >= 0.85), b AS (SELECT x, y FROM s UNION ALL SELECT y, x FROM s),
 w AS (SELECT DISTINCT unnest(x) AS a, y FROM b), f AS (SELECT a, list_filter(y, lambda e: length(e) >= length(a) + 3 AND substr(e, 1, 1) = substr(a, 1, 1) AND len(list_filter(string_split(substr(a, 2), ''), lambda c: NOT contains(e, c))) = 0) AS fits FROM w WHERE length(a) BETWEEN 2 AND 4 AND NOT list_contains(y, a) AND regexp_full_match(a, '[\\p{{L}}0-9]+') AND NOT regexp_matches(a, '^[0-9]'))
 SELECT DISTINCT a AS abbreviation, fits[1] AS full_form FROM f WHERE len(fits) > 0""")
def learned_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """What confirmed links add to an empty dictionary."""
    pairs = spark.sql(_PAIRS + " {specs}", specs=A.specs(spark, d)).select(F.lower("spec").alias("spec"), F.lower("offer").alias("offer"), "confidence")
    return Y.learned(Y.seed(spark).where("false"), pairs).select("abbreviation", "full_form")


# --- numbers --------------------------------------------------------------------

_WRITTEN = "CASE spec_id % 6 WHEN 0 THEN concat(CAST(spec_id AS STRING), ',50 руб.') WHEN 1 THEN concat('1 ', CAST(100 + spec_id % 900 AS STRING), ',25') WHEN 2 THEN concat(CAST(spec_id AS STRING), ' шт') WHEN 3 THEN concat('1.', CAST(100 + spec_id % 900 AS STRING), ',75') WHEN 4 THEN 'нет' ELSE CAST(spec_id AS STRING) END"
_SQUEEZED = r"regexp_replace(regexp_replace(t, '\s', '', 'g'), '(?i)руб\.?', '', 'g')"
_PREFIX = r"'^([+-]?(?:\d+\.?\d*|\.\d+))'"
_IS = r"'^[+-]?(?:\d+\.?\d*|\.\d+)$'"


@query("named", f""", w AS (SELECT spec_id, {_WRITTEN} AS t FROM named), v AS (SELECT *, regexp_replace(regexp_replace(trim(t), '(?i)\\s*(?:руб|₽|р)\\.?\\s*$', ''), ' ', '', 'g') AS tab, replace(regexp_extract(t, '[-+]?\\d[\\d\\s.,]*'), ' ', '') AS f, replace(regexp_replace(t, '[^0-9,.\\-+]', '', 'g'), ',', '.') AS d FROM w)
 SELECT spec_id, TRY_CAST(nullif(regexp_extract(replace({_SQUEEZED}, ',', '.'), {_PREFIX}, 1), '') AS DOUBLE) AS price, TRY_CAST(nullif(regexp_extract(regexp_replace(replace(t, ',', '.'), '\\s', '', 'g'), {_PREFIX}, 1), '') AS DOUBLE) AS sheet,
  CASE WHEN regexp_matches(replace(tab, ',', '.'), {_IS}) THEN CAST(replace(tab, ',', '.') AS DOUBLE) END AS tabled, CASE WHEN regexp_matches(replace(replace(trim(t), ',', '.'), ' ', ''), {_IS}) THEN CAST(replace(replace(trim(t), ',', '.'), ' ', '') AS DOUBLE) END AS plain,
  TRY_CAST(CASE WHEN contains(f, ',') AND contains(f, '.') THEN replace(replace(f, '.', ''), ',', '.') ELSE replace(f, ',', '.') END AS DOUBLE) AS first_one,
  TRY_CAST(CASE WHEN regexp_matches(t, 'руб') THEN replace(rtrim(d, '.'), '.', '') || '.' WHEN len(regexp_extract_all(d, '\\.')) > 1 THEN replace(regexp_extract(d, '^(.*)\\.([^.]*)$', 1), '.', '') || '.' || regexp_extract(d, '^(.*)\\.([^.]*)$', 2) ELSE nullif(d, '') END AS DOUBLE) AS bare FROM v""")
def number_parsers(spark: SparkSession, d: str) -> DataFrame:
    """One text read in the six ways in which the sources read numbers."""
    t = A.named(spark, d).selectExpr("spec_id", f"{_WRITTEN} AS t")
    return t.select("spec_id", *[f(F.col("t")).alias(n) for n, f in (("price", U.price), ("sheet", U.sheet_number), ("tabled", U.table_number), ("plain", U.plain_number), ("first_one", U.first_number), ("bare", U.decimal_text))])


# --- search ----------------------------------------------------------------------


@query("named", " SELECT spec_id, name FROM named WHERE contains(lower(name), 'кран') OR contains(lower(sheet), 'кран') ORDER BY spec_id LIMIT 30")
def like_search_top30(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).where(F.contains(F.lower("name"), F.lit("кран")) | F.contains(F.lower("sheet"), F.lit("кран"))).select("spec_id", "name").orderBy("spec_id").limit(30)


def _searched(least: float, top: int) -> str:
    return f""", n AS (SELECT name, min(spec_id) AS spec_id, replace({O.plain('name')}, ' ', '') AS t FROM named GROUP BY name), q AS (SELECT replace('кран шаровой dn 25 pn16', ' ', '') AS u),
 s AS (SELECT spec_id, name, {O.dice('t', 'u')} AS dice FROM n, q), top AS (SELECT * FROM s ORDER BY dice DESC, spec_id LIMIT {top})
 SELECT spec_id, name, floor(dice * 1000 + 0.5) / 1000 AS dice FROM top WHERE dice > {least}"""


def _search(spark: SparkSession, d: str, least: float, top: int) -> DataFrame:
    """The ``top`` names most like what is asked, then those of them above ``least``."""
    names = A.named(spark, d).groupBy("name").agg(F.min("spec_id").alias("spec_id"))
    asked = spark.createDataFrame([(0, "кран шаровой dn 25 pn16")], "id long, name string")
    texts = names.select("spec_id", "name", T.with_aliases(T.normalized(F.col("name"))).alias("text"))
    near = dice_join(texts.select(F.struct("spec_id", "name").alias("id"), F.col("text").alias("name")), asked, least).where(F.col("dice") > least)
    return near.orderBy(F.desc("dice"), "a.spec_id").limit(top).select("a.spec_id", "a.name", _round(F.col("dice")).alias("dice"))


@query("named", _searched(0.1, 30))
def dice_vs_query_top30(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 0.1, 30)


@query("named", _searched(0.15, 10))
def dice_vs_query_top10(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, 0.15, 10)


_TOKENS = r"list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(replace(lower(name), 'ё', 'е'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')), lambda t: length(t) >= 3)"


@query("named", f""", n AS (SELECT name, min(spec_id) AS b, {_TOKENS} AS tokens FROM named GROUP BY name), q AS (SELECT b % 5 AS batch, tokens FROM n WHERE b % 40 = 0),
 s AS (SELECT batch, b, max(len(list_intersect(q.tokens, n.tokens)) / sqrt(CAST(len(q.tokens) * len(n.tokens) AS DOUBLE))) AS score FROM q, n WHERE len(list_intersect(q.tokens, n.tokens)) > 0 GROUP BY batch, b)
 SELECT batch, b, floor(score * 1000 + 0.5) / 1000 AS score, CAST(row_number() OVER (PARTITION BY batch ORDER BY floor(score * 1e9 + 0.5) DESC, b) AS INT) AS rank FROM s QUALIFY rank <= 120""")
def token_overlap_top_n(spark: SparkSession, d: str) -> DataFrame:
    n = A.named(spark, d).groupBy("name").agg(F.min("spec_id").alias("b")).select("b", N.tokens(F.col("name")).alias("tokens"))
    top = token_overlap_top(n.where("b % 40 = 0").select((F.col("b") % 5).alias("batch"), "tokens"), n, 120)
    return top.select("batch", "b", _round(F.col("score")).alias("score"), "rank")


@query("named", """, n AS (SELECT DISTINCT spec_id % 12 AS kind, name FROM named WHERE spec_id % 12 IN (1, 7))
 SELECT a.name AS left_name, b.name AS right_name, floor((1 - levenshtein(lower(a.name), lower(b.name)) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE)) * 1000 + 0.5) / 1000 AS similarity FROM n a JOIN n b ON a.kind = b.kind AND right(a.name, 1) = right(b.name, 1) AND a.name < b.name""")
def edit_similarity(spark: SparkSession, d: str) -> DataFrame:
    n = A.named(spark, d).where("spec_id % 12 IN (1, 7)").selectExpr("spec_id % 12 AS kind", "right(name, 1) AS tail", "name").distinct()
    pairs = n.alias("a").join(n.alias("b"), F.expr("a.kind = b.kind AND a.tail = b.tail AND a.name < b.name"))
    return pairs.select(F.col("a.name").alias("left_name"), F.col("b.name").alias("right_name"), _round(N.edit_similarity(F.lower("a.name"), F.lower("b.name"))).alias("similarity"))
