"""Queries over rows of paged specifications and their parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.operators import page_hierarchy as P
from larkspan.plans import oracle as O
from larkspan.plans.registry import query
from larkspan.sources import adapters as A

#: Rows as a paged specification has them, a document a brand; the same text runs in Spark and in DuckDB.
_PAGE = """SELECT p_brand AS document, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS ordinal,
 CASE (p_partkey * 7 + p_size) % 14 WHEN 0 THEN 'Труба стальная водогазопроводная' WHEN 1 THEN 'DN 50' WHEN 2 THEN 'C22-300-500' WHEN 3 THEN 'То же, 300x200' WHEN 4 THEN 'из оцинкованной стали' WHEN 5 THEN 'Неподвижная опора' WHEN 6 THEN concat('Ø', CAST(10 + p_size AS STRING))
  WHEN 7 THEN concat('Насос UPS ', CAST(p_size AS STRING)) WHEN 8 THEN 'Кран шаровой муфтовый' WHEN 9 THEN 'исполнение левое' WHEN 10 THEN concat('Ø', CAST(15 + p_size AS STRING), 'х3,2') WHEN 11 THEN '300x200' WHEN 12 THEN 'Клапан обратный' ELSE concat('Ду ', CAST(10 + p_size AS STRING)) END AS name,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(1 + p_partkey % 5 AS STRING) END AS position_number, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS quantity, CASE WHEN p_size % 4 = 0 THEN 'шт' END AS unit, CASE WHEN p_size % 17 = 0 THEN 'Завод' END AS manufacturer,
 CASE WHEN p_partkey % 4 = 1 THEN CAST(1 + (p_partkey * 3) % 6 AS STRING) END AS parent_position, CASE WHEN p_partkey % 5 = 2 THEN CASE p_partkey % 4 WHEN 0 THEN 'труба стальная' WHEN 1 THEN 'кран шаровыи' WHEN 2 THEN 'насос ups' ELSE 'задвижка' END END AS parent_name_hint
FROM {part}"""


def page_rows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_PAGE, part=A.read(spark, d, "part"))


_FORM = "trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^a-zа-я0-9]+', ' ', 'g'))"
_ALIKE = f"CASE WHEN {_FORM.format('r.parent_name_hint')} = '' OR {_FORM.format('cand.txt')} = '' THEN 0.0 WHEN length({_FORM.format('r.parent_name_hint')}) >= 4 AND {_FORM.format('cand.txt')} <> {_FORM.format('r.parent_name_hint')} AND (contains({_FORM.format('cand.txt')}, {_FORM.format('r.parent_name_hint')}) OR contains({_FORM.format('r.parent_name_hint')}, {_FORM.format('cand.txt')})) THEN 0.9 ELSE {O.dice(_FORM.format('r.parent_name_hint'), _FORM.format('cand.txt'))} END"
# Row by row: what has been seen is carried along, so that this shares no step with the windows.
_LINKED = (
    "WITH RECURSIVE page AS (" + _PAGE.format(part="part") + r"""), flag AS (SELECT *, regexp_matches(name, '^Ø\d{1,4}') AS bare, regexp_matches(name, '(?i)^(?:DN|Ду|Дн|d=|D=|du)\s*\d{2,}(?:\s|$|[xXхХ×/,-])') AS dn, regexp_matches(name, '(?i)^то\s+же') AS same, regexp_matches(name, '^[A-Za-zА-Яа-я]{1,3}\s?\d{1,4}([-_]\d{2,4}){1,3}$') AS code,
  quantity IS NULL AND unit IS NULL AND manufacturer IS NULL AS plain, regexp_matches(name, '(?i)^(δ|d|du|dn|ø|⌀)\s*=?\s*\d{1,4}|(^|[^A-Za-z0-9_])\d{1,4}\s*[xх×]\s*\d{1,4}([^A-Za-z0-9_]|$)') AS sized, length(regexp_replace(name, '[^А-Яа-яЁёA-Za-z]', '', 'g')) AS letters FROM page),
 row_ AS (SELECT *, plain AND position_number IS NULL AND length(name) >= 5 AND NOT bare AND NOT dn AND NOT sized AND letters >= 4 AND coalesce(lead(bare) OVER (PARTITION BY document ORDER BY ordinal), false) AS heads, dn OR code OR (sized AND length(name) <= 25) AS child FROM flag),
 walk AS (
  SELECT DISTINCT document, CAST(-1 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS last, CAST(NULL AS VARCHAR) AS acc, CAST([] AS STRUCT(o BIGINT, pos VARCHAR, txt VARCHAR, root BOOLEAN)[]) AS seen, '' AS name, CAST(NULL AS VARCHAR) AS full_name, CAST(NULL AS BIGINT) AS parent, '' AS role, CAST(NULL AS VARCHAR) AS pos, CAST(NULL AS DOUBLE) AS quantity FROM page
  UNION ALL
  SELECT document, k, CASE WHEN role = 'group' THEN k ELSE last END, CASE WHEN role = 'group' THEN name WHEN role = 'continued' THEN acc || ' ' || name ELSE acc END,
   list_append(CASE WHEN role = 'continued' THEN list_transform(seen, lambda x: CASE WHEN x.o = last THEN {'o': x.o, 'pos': x.pos, 'txt': acc || ' ' || name, 'root': x.root} ELSE x END) ELSE seen END, {'o': k, 'pos': pos, 'txt': coalesce(full_name, name), 'root': parent IS NULL}), name, full_name, parent, role, pos, quantity
  FROM (
   SELECT document, k, last, acc, seen, role, CASE WHEN role = 'child' AND misplaced THEN NULL ELSE position_number END AS pos, CASE WHEN role = 'child' AND misplaced THEN coalesce(quantity, CAST(position_number AS DOUBLE)) ELSE quantity END AS quantity,
    CASE WHEN role = 'same' THEN trim(acc || ' ' || regexp_replace(name, '(?i)^то\s+же[,\s]*', '')) ELSE name END AS name, CASE role WHEN 'told' THEN list_filter(seen, lambda x: x.o = hint)[1].txt || ' ' || name WHEN 'same' THEN trim(acc || ' ' || regexp_replace(name, '(?i)^то\s+же[,\s]*', '')) WHEN 'child' THEN acc || ' ' || name END AS full_name,
    CASE role WHEN 'told' THEN hint WHEN 'same' THEN last WHEN 'child' THEN last WHEN 'continued' THEN last END AS parent
   FROM (
    SELECT *, position_number IS NOT NULL AND last IS NOT NULL AND bare AS misplaced, CASE WHEN position_number IS NOT NULL THEN CASE WHEN last IS NOT NULL AND bare THEN 'child' ELSE 'group' END WHEN hint IS NOT NULL THEN 'told' WHEN same THEN CASE WHEN last IS NULL THEN 'single' ELSE 'same' END WHEN heads THEN 'group'
     WHEN last IS NOT NULL AND plain AND NOT child THEN 'continued' WHEN dn OR bare THEN CASE WHEN last IS NULL THEN 'single' ELSE 'child' END WHEN code AND last IS NOT NULL THEN 'child' ELSE 'group' END AS role
    FROM (
     SELECT w.document, w.k + 1 AS k, w.last, w.acc, w.seen, r.* EXCLUDE (document, ordinal), CASE WHEN r.position_number IS NULL THEN coalesce(list_max(list_transform(list_filter(w.seen, lambda x: x.pos = r.parent_position), lambda x: x.o)),
       CASE WHEN r.parent_name_hint IS NOT NULL THEN (list_filter([list_sort(list_transform(list_filter(w.seen, lambda x: x.root), lambda cand: {'s': CAST(""" + _ALIKE + r""" AS DOUBLE), 'o': cand.o}))[-1]], lambda b: b.s >= 0.5)[1]).o END) END AS hint
     FROM walk w JOIN row_ r ON r.document = w.document AND r.ordinal = w.k + 1)))),
 ends AS (SELECT document, unnest(arg_max(seen, k)) AS x FROM walk GROUP BY document),
 numbered AS (SELECT *, k - count(*) FILTER (role = 'continued') OVER (PARTITION BY document ORDER BY k) + CASE WHEN role = 'continued' THEN 1 ELSE 0 END AS at FROM walk WHERE k >= 0)"""
)


@query(sql=f"""{_LINKED} SELECT n.document, n.at AS ordinal, n.pos AS position_number, n.name, CASE WHEN n.role = 'group' THEN nullif(e.x.txt, n.name) ELSE n.full_name END AS full_name, p.at AS parent, n.quantity, n.role
 FROM numbered n JOIN ends e ON e.document = n.document AND e.x.o = n.k LEFT JOIN numbered p ON p.document = n.document AND p.k = n.parent WHERE n.role <> 'continued'""")
def page_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Rows of paged specifications with their parents and whole names."""
    return P.linked_pages(page_rows(spark, d))


_TOP = "position_number IS NULL AND (parent_position IS NOT NULL OR parent_name_hint IS NOT NULL)"


@query(sql=f"""WITH page AS ({_PAGE.format(part="part")}), named AS (SELECT h.document, h.ordinal, c.ordinal AS above, c.position_number, {_ALIKE.replace('r.parent_name_hint', 'h.parent_name_hint').replace('cand.txt', 'c.name')} AS s, h.parent_position FROM page h JOIN page c ON c.document = h.document AND c.ordinal < h.ordinal AND c.ordinal >= h.ordinal - 600 WHERE h.position_number IS NULL AND (h.parent_position IS NOT NULL OR h.parent_name_hint IS NOT NULL)),
 best AS (SELECT document, ordinal, max(above) FILTER (position_number = parent_position) AS by_position, max({{'s': CAST(coalesce(s, 0) AS DOUBLE), 'o': above}}) FILTER (position_number IS NOT NULL) AS x FROM named GROUP BY ALL)
 SELECT p.document, p.ordinal, coalesce(b.by_position, CASE WHEN p.parent_name_hint IS NOT NULL AND b.x.s >= 0.5 THEN b.x.o END) AS parent FROM page p LEFT JOIN best b ON b.document = p.document AND b.ordinal = p.ordinal WHERE {_TOP}""")
def nearest_parent(spark: SparkSession, d: str) -> DataFrame:
    """For every row that says what it belongs to, the nearest row above that it means; numbered rows are those that can be named."""
    rows = page_rows(spark, d).withColumns({"position": F.col("position_number"), "role": F.when(F.col("position_number").isNotNull(), "group").otherwise("child"), "group": F.col("ordinal"), "above": F.lit(None).cast("long")})
    return P.nearest_parent(rows, P.LOOK_BACK)
