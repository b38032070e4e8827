"""Documents, table rows, hierarchies and comparisons as queries, each beside its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.functions import documents as D
from larkspan.functions import names as N
from larkspan.functions import text as T
from larkspan.operators import feedback as B
from larkspan.operators import hierarchy as H
from larkspan.operators import scoring as C
from larkspan.plans import oracle as O
from larkspan.plans.registry import query
from larkspan.sources import adapters as A

# --- text of documents ---------------------------------------------------------

_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN concat('Счёт № A-', CAST(o_orderkey AS STRING), ' от 05.03.2024', chr(10), 'Поставщик: ООО Ромашка, условия оплаты', chr(10), 'Итого: 1 234,50 руб')
 WHEN 1 THEN concat('Коммерческое предложение № КП/', CAST(o_orderkey AS STRING), chr(10), '14 марта 2024 г.', chr(10), 'ООО «Вектор» скидка 12,5 %', chr(10), 'Всего наименований 3, на сумму 9 876,00 руб.')
 WHEN 2 THEN concat('invoice #', CAST(o_orderkey AS STRING), ' дата: 1.2.2023 продавец: АО Сталь;', chr(10), 'итого 500') WHEN 3 THEN concat('№ ', CAST(o_orderkey + 10 AS STRING), ' 12.12.2022 без реквизитов') ELSE 'пусто' END"""
_PAPERS = f"WITH papers AS (SELECT o_orderkey AS invoice_id, {_TEXT} AS text FROM orders)"


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "orders").selectExpr("o_orderkey AS invoice_id", f"{_TEXT} AS text")


_NUMBER = r"([A-Za-zА-Яа-я0-9\-/]+)"
_MONTH = "CASE lower(regexp_extract(text, '(?i)(\\d{1,2})\\s+(" + "|".join(D.MONTHS) + ")\\s+(\\d{4})', 2)) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(D.MONTHS, 1)) + " END"
_SPELT = "(?i)(\\d{1,2})\\s+(" + "|".join(D.MONTHS) + ")\\s+(\\d{4})"
_CLEAN = lambda raw: f"CASE WHEN length(trim(regexp_replace(trim(split_part({raw}, ',', 1)), '[.;:]+$', ''))) BETWEEN 2 AND 80 AND NOT {O.any_of(f'lower(split_part({raw}, chr(44), 1))', N.NO_SUPPLIER)} THEN trim(regexp_replace(trim(split_part({raw}, ',', 1)), '[.;:]+$', '')) END"
_MONEY = lambda raw: f"TRY_CAST(replace(regexp_replace({raw}, '\\s', '', 'g'), ',', '.') AS DOUBLE)"
_FIRM = O.found("text", r"((?:ООО|ОАО|ЗАО|ПАО|НАО|ФГУП|ИП|АО)\s*[«\"'(]?[^»\"')\n]{2,50})")
_LABELLED = O.found("text", r"(?i)(?:поставщик|продавец|исполнитель)\s*[:\s]*([^\n]{3,60})")


@query("", _PAPERS + f""", m AS (SELECT invoice_id, text, {_LABELLED} AS labelled, trim({_FIRM}) AS firm FROM papers)
 SELECT invoice_id, coalesce({O.found('text', r'(?i)(?:счёт|счет|invoice)\s*[№#:]\s*' + _NUMBER)}, {O.found('text', r'(?i)(?:заказ\s+клиента|КП|коммерческое\s+предложение)\s*(?:[^№#]*?)[№#]\s*' + _NUMBER)}, {O.found('text', r'№\s*([A-Za-zА-Яа-я0-9\-/]{2,})')}) AS number,
 coalesce({O.found('text', r'(?i)(?:от|date|дата)\s*[:\s]*(\d{1,2}[.\-/]\d{1,2}[.\-/]\d{4})')}, lpad({O.found('text', _SPELT)}, 2, '0') || '.' || {_MONTH} || '.' || {O.found('text', _SPELT, 3)}, {O.found('text', r'(\d{2}[.\-/]\d{2}[.\-/]\d{4})')}) AS date,
 coalesce({_CLEAN('labelled')}, regexp_replace({_CLEAN('firm')}, '[«"''(]', '', 'g')) AS supplier, coalesce({_MONEY(O.found('text', r'(?i)на\s+сумму\s+(\d[\d\s]*(?:[.,]\d+)?)'))}, {_MONEY(O.found('text', r'(?i)итого[^\d\n]{0,40}(\d[\d\s]*(?:[.,]\d+)?)'))}) AS total,
 TRY_CAST(replace({O.found('text', r'(?i)скидк[а-яё]*\s+(\d+[,.]?\d*)\s*%')}, ',', '.') AS DOUBLE) AS discount FROM m""")
def metadata_regex(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("invoice_id", D.metadata(F.col("text")).alias("m")).select("invoice_id", "m.*")


@query("", _PAPERS + f""" SELECT invoice_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '' AND NOT (length(l) > 120 OR {' OR '.join(f"starts_with(lower(l), {O.quoted(w)})" for w in D.REQUISITES)} OR len(list_filter([{', '.join(map(O.quoted, D.REQUISITES))}], lambda k: contains(lower(l), k))) >= 2)), chr(10)) AS text FROM papers""")
def metadata_lines_removed(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("invoice_id", D.without_metadata_lines(F.col("text")).alias("text"))


@query("", r"""WITH w AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'Here: ```json {"n": ' || doc_id || '} ```' WHEN 1 THEN 'so {"n": ' || doc_id || '} it is' ELSE ' none ' END AS answer FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(answer, '(?s)```(?:json)?\s*.*?```') THEN trim(regexp_extract(answer, '(?s)```(?:json)?\s*(.*?)```', 1)) ELSE coalesce(nullif(regexp_extract(answer, '(?s)(\{.*\})', 1), ''), trim(answer)) END AS json FROM w""")
def json_in_answers(spark: SparkSession, d: str) -> DataFrame:
    answer = F.expr("CASE doc_id % 3 WHEN 0 THEN concat('Here: ```json {\"n\": ', doc_id, '} ```') WHEN 1 THEN concat('so {\"n\": ', doc_id, '} it is') ELSE ' none ' END")
    return A.read(spark, d, "documents").select("doc_id", D.json_text(answer).alias("json"))


_INN = "CAST(1000000000 + (s_suppkey * 7919) % 900000000 AS STRING)"
_DIGIT = lambda i: f"CAST(substr(inn, {i}, 1) AS INT)"
_SUM = " + ".join(f"{_DIGIT(i)} * {w}" for i, w in enumerate((2, 4, 10, 3, 5, 9, 4, 6, 8), 1))


@query("", f"WITH x AS (SELECT s_suppkey AS supplier_id, {_INN} AS inn FROM supplier) SELECT supplier_id, inn, ({_SUM}) % 11 % 10 = {_DIGIT(10)} AS valid FROM x")
def taxid_checksum(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "supplier").selectExpr("s_suppkey AS supplier_id", f"{_INN} AS inn").select("supplier_id", "inn", T.tax_id_valid(F.col("inn")).alias("valid"))


# --- heads and rows of tables ----------------------------------------------------

_HEAD = "CASE spec_id % 9 WHEN 0 THEN 'Наименование товара' WHEN 1 THEN 'Кол-во' WHEN 2 THEN 'Цена без НДС' WHEN 3 THEN 'Сумма с НДС' WHEN 4 THEN 'Артикул' WHEN 5 THEN 'Ед. изм.' WHEN 6 THEN 'НДС, руб' WHEN 7 THEN 'Сумма со скидкой с учётом НДС' ELSE 'Прочее' END"
_WITH, _WITHOUT, _BARE = r"regexp_matches(h, 'с\s+ндс|с\s+уч[её]том\s+ндс|включая\s+ндс')", r"regexp_matches(h, 'без\s+ндс')", r"regexp_matches(h, '(?:^|[^а-яё])ндс(?:$|[^а-яё])')"


@query("named", f""", x AS (SELECT spec_id, lower({_HEAD}) AS h FROM named) SELECT spec_id, CASE {' '.join(f"WHEN {O.any_of('h', words)} THEN '{field}'" for field, words in D.HEADS.items())} END AS field, CASE WHEN {_WITHOUT} THEN false WHEN {_WITH} THEN true END AS with_vat,
 CAST(CASE WHEN {_BARE} AND NOT {_WITH} AND NOT {_WITHOUT} THEN -50 ELSE 0 END + CASE WHEN {_WITHOUT} THEN -20 WHEN {_WITH} THEN 20 ELSE 0 END + CASE WHEN regexp_matches(h, 'без\\s+скидк') THEN -20 WHEN regexp_matches(h, 'скидк') THEN 30 ELSE 0 END AS INT) AS score FROM x""")
def header_column_map(spark: SparkSession, d: str) -> DataFrame:
    h = A.named(spark, d).selectExpr("spec_id", f"{_HEAD} AS h")
    return h.select("spec_id", D.field_of_head(F.col("h")).alias("field"), D.column_vat(F.col("h")).alias("with_vat"), D.amount_head_score(F.col("h")).alias("score"))


_ROW = "CASE spec_id % 13 WHEN 0 THEN 'Итого: 100' WHEN 1 THEN 'Поставщик ООО, банк' WHEN 2 THEN 'Отопление' WHEN 3 THEN 'IV. Материалы' WHEN 4 THEN 'Доставка до объекта' WHEN 5 THEN 'телефон склада' ELSE name END"
_META = f"(length(r) > 120 OR {' OR '.join(f'starts_with(lower(r), {O.quoted(w)})' for w in D.REQUISITES)} OR len(list_filter([{', '.join(map(O.quoted, D.REQUISITES))}], lambda k: contains(lower(r), k))) >= 2)"


@query("named", f""", x AS (SELECT spec_id, {_ROW} AS r, CASE WHEN spec_id % 13 IN (2, 3) THEN NULL ELSE quantity END AS q, CASE WHEN spec_id % 13 IN (2, 3) THEN NULL ELSE unit END AS u FROM named)
 SELECT spec_id, {_META} AS metadata, regexp_matches(trim(lower(r)), '^(?:итого|всего|в том числе|сумма ндс|ндс)(?:\\s|:|$)') AS summary, q IS NULL AND trim(coalesce(u, '')) = '' AND (regexp_matches(trim(lower(r)), '^(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\\.?\\s+') OR (regexp_matches(trim(lower(r)), '^[а-яa-z\\s/-]{{3,40}}$') AND len(regexp_split_to_array(trim(lower(r)), '\\s+')) <= 3)) AS section,
 {O.any_of('lower(r)', D.DELIVERY)} AS delivery, CAST(len(list_filter([{', '.join(map(O.quoted, D.GOODS_HEADS))}], lambda k: contains(lower(r), k))) AS INT) AS head_words FROM x""")
def row_kinds(spark: SparkSession, d: str) -> DataFrame:
    x = A.named(spark, d).selectExpr("spec_id", f"{_ROW} AS r", "CASE WHEN spec_id % 13 IN (2, 3) THEN NULL ELSE quantity END AS q", "CASE WHEN spec_id % 13 IN (2, 3) THEN NULL ELSE unit END AS u")
    r = F.col("r")
    return x.select("spec_id", D.is_metadata_row(r).alias("metadata"), D.is_summary_row(r).alias("summary"), D.is_section_row(r, F.col("q"), F.col("u")).alias("section"), D.is_delivery(r).alias("delivery"), D.table_score(r).alias("head_words"))


_LINE = "CASE spec_id % 3 WHEN 0 THEN concat(name, chr(9), ' 5 ', chr(9), 'шт') WHEN 1 THEN concat(name, '   ', CAST(spec_id AS STRING), '  ', 'м') ELSE name END"


@query("named", f", x AS (SELECT spec_id, {_LINE} AS line FROM named) SELECT spec_id, array_to_string(list_transform(CASE WHEN contains(line, chr(9)) THEN string_split(line, chr(9)) ELSE regexp_split_to_array(trim(line), '\\s{{2,}}') END, lambda c: trim(c)), '|') AS cells FROM x")
def text_cells(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).selectExpr("spec_id", f"{_LINE} AS line").select("spec_id", F.array_join(D.cells(F.col("line")), "|").alias("cells"))


@query("named", ", x AS (SELECT spec_id, (spec_id * 7) % 101 AS h, (spec_id * 13) % 101 AS c, (spec_id * 29) % 101 AS a FROM named), y AS (SELECT *, CAST(floor(h * 0.30 + c * 0.30 + a * 0.40 + 0.5) AS INT) AS overall FROM (SELECT spec_id, CAST(h AS DOUBLE) AS h, CAST(c AS DOUBLE) AS c, CAST(a AS DOUBLE) AS a FROM x)) SELECT spec_id, overall, CASE WHEN overall >= 80 THEN 'A' WHEN overall >= 50 THEN 'B' ELSE 'C' END AS category FROM y")
def parse_confidence(spark: SparkSession, d: str) -> DataFrame:
    x = A.named(spark, d).select("spec_id", D.parse_confidence(F.expr("(spec_id * 7) % 101").cast("double"), F.expr("(spec_id * 13) % 101").cast("double"), F.expr("(spec_id * 29) % 101").cast("double")).alias("x"))
    return x.select("spec_id", "x.*")


# --- hierarchies ------------------------------------------------------------------


def _items(spark: SparkSession, d: str) -> DataFrame:
    return A.named(spark, d).select("sheet", F.col("spec_id").alias("ordinal"), "name", "position_number", "quantity", "unit")


_CHILD = r"(position_number IS NULL AND regexp_matches(trim(name), '(?i)^(?:DN|Ду|d=|D=|du)\s*\d{2,}(?:\s|$|[xX×/\-])'))"
_CONTINUES = r"regexp_matches(trim(name), '(?i)^(?:толщиной|толщ\.|сечение|сеч\.|длиной|дл\.|шириной|высотой|диаметром|ø|h=|l=|w=|b=|с\s+нанесением|с\s+покрытием|класса\s+герметичности)')"


@query("named", f""", g AS (SELECT *, position_number IS NULL AND NOT {_CHILD} AND ({_CONTINUES} OR (quantity IS NULL AND unit IS NULL)) AS goes_on FROM named),
 s AS (SELECT *, CASE WHEN NOT goes_on OR row_number() OVER (PARTITION BY sheet ORDER BY spec_id) = 1 THEN 1 ELSE 0 END AS starts FROM g), i AS (SELECT *, sum(starts) OVER (PARTITION BY sheet ORDER BY spec_id) AS island FROM s)
 SELECT sheet, min(spec_id) AS ordinal, string_agg(name, ' ' ORDER BY spec_id) AS name, arg_min(coalesce(position_number, '-'), spec_id) AS position_number, arg_min(coalesce(quantity, -1), spec_id) AS quantity FROM i GROUP BY sheet, island""")
def continuation_islands(spark: SparkSession, d: str) -> DataFrame:
    t = H.merged_continuations(_items(spark, d))
    return t.select("sheet", "ordinal", "name", F.coalesce("position_number", F.lit("-")).alias("position_number"), F.coalesce("quantity", F.lit(-1.0)).alias("quantity"))


@query()
def spec_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return H.linked_rows(_items(spark, d))


@query()
def hierarchy_reindexed(spark: SparkSession, d: str) -> DataFrame:
    linked = H.linked_rows(_items(spark, d))
    return H.without_rows(linked, _items(spark, d).where("ordinal % 10 = 3").select("sheet", "ordinal"))


# --- comparisons --------------------------------------------------------------------

_REF = "SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx, l_partkey, concat('item ', CAST(l_partkey AS STRING), ' grade ', CAST(l_linenumber AS STRING)) AS name, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS article, l_extendedprice AS price, l_quantity AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'шт' ELSE 'м' END AS unit, lead(concat('item ', CAST(l_partkey AS STRING), ' grade ', CAST(l_linenumber AS STRING))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS next_name FROM lineitem"
_RESULT = "SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS idx, CASE WHEN idx % 4 = 1 THEN concat(name, ' x') WHEN idx % 4 = 2 AND next_name IS NOT NULL THEN concat(name, ' ', next_name) ELSE name END AS name, article, CASE WHEN idx % 3 = 2 THEN price * 1.2 ELSE price END AS price, quantity, unit FROM refs WHERE (doc + idx) % 5 <> 4"
_SIDES = f"WITH refs AS ({_REF}), results AS ({_RESULT})"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    ref = A.read(spark, d, "lineitem").withColumn("idx", F.row_number().over(order).cast("long") - 1).selectExpr("l_orderkey AS doc", "idx", "concat('item ', CAST(l_partkey AS STRING), ' grade ', CAST(l_linenumber AS STRING)) AS name", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END AS article", "l_extendedprice AS price", "l_quantity AS quantity", "CASE WHEN l_linenumber % 2 = 0 THEN 'шт' ELSE 'м' END AS unit")
    ref = ref.withColumn("next_name", F.lead("name").over(Window.partitionBy("doc").orderBy("idx")))
    result = ref.where("(doc + idx) % 5 <> 4").withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("idx")).cast("long") - 1)
    return ref, result.selectExpr("doc", "at AS idx", "CASE WHEN idx % 4 = 1 THEN concat(name, ' x') WHEN idx % 4 = 2 AND next_name IS NOT NULL THEN concat(name, ' ', next_name) ELSE name END AS name", "article", "CASE WHEN idx % 3 = 2 THEN price * 1.2 ELSE price END AS price", "quantity", "unit")


_PAIRED = _SIDES + """, ur AS (SELECT doc, article, min(idx) AS idx FROM refs WHERE article <> '' GROUP BY doc, article HAVING count(*) = 1), us AS (SELECT doc, article, min(idx) AS idx FROM results WHERE article <> '' GROUP BY doc, article HAVING count(*) = 1),
 a AS (SELECT ur.doc, ur.idx AS ref_idx, us.idx AS result_idx FROM ur JOIN us USING (doc, article)), fr AS (SELECT doc, idx FROM refs WHERE (doc, idx) NOT IN (SELECT (doc, ref_idx) FROM a)), fs AS (SELECT doc, idx FROM results WHERE (doc, idx) NOT IN (SELECT (doc, result_idx) FROM a)),
 pairs AS (SELECT doc, ref_idx, result_idx, 'article' AS method FROM a UNION ALL SELECT coalesce(fr.doc, fs.doc), fr.idx, fs.idx, CASE WHEN fr.idx IS NOT NULL AND fs.idx IS NOT NULL THEN 'position' WHEN fr.idx IS NOT NULL THEN 'missing_result' ELSE 'extra_result' END FROM fr FULL JOIN fs ON fr.doc = fs.doc AND fr.idx = fs.idx)"""


@query("", _PAIRED + " SELECT doc, ref_idx, result_idx, method FROM pairs")
def row_pairs_by_article(spark: SparkSession, d: str) -> DataFrame:
    return C.row_pairs(*_sides(spark, d))


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    ref, result = _sides(spark, d)
    pairs = C.row_pairs(ref, result)
    r, s = (t.select("doc", F.col("idx").alias(f"{side}_idx"), *[F.col(c).alias(f"{side}_{c}") for c in ("name", "article", "price")]) for t, side in ((ref, "ref"), (result, "result")))
    t = pairs.join(r, ["doc", "ref_idx"], "left").join(s, ["doc", "result_idx"], "left")
    equal = {"name": F.expr("lower(ref_name) = lower(result_name)"), "article": F.expr("ref_article = result_article"), "price": F.expr("abs(ref_price - result_price) <= 0.01")}
    return t.select("doc", *[C.field_status(F.col(f"ref_{c}").isNotNull(), F.col(f"result_{c}").isNotNull(), e).alias(c) for c, e in equal.items()])


_STATUS = lambda c, e: f"CASE WHEN r.{c} IS NULL THEN 'MISSING_REF' WHEN s.{c} IS NULL THEN 'MISSING_RESULT' WHEN {e} THEN 'OK' ELSE 'FAIL' END"


@query("", _PAIRED + f""", st AS (SELECT {_STATUS('name', 'lower(r.name) = lower(s.name)')} AS name, {_STATUS('article', 'r.article = s.article')} AS article, {_STATUS('price', 'abs(r.price - s.price) <= 0.01')} AS price FROM pairs p LEFT JOIN refs r ON r.doc = p.doc AND r.idx = p.ref_idx LEFT JOIN results s ON s.doc = p.doc AND s.idx = p.result_idx),
 u AS (SELECT 'name' AS field, name AS status FROM st UNION ALL SELECT 'article', article FROM st UNION ALL SELECT 'price', price FROM st)
 SELECT field, CAST(count(*) FILTER (status = 'OK') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'FAIL') AS BIGINT) AS fail, CAST(count(*) FILTER (status = 'MISSING_REF') AS BIGINT) AS missing_ref, CAST(count(*) FILTER (status = 'MISSING_RESULT') AS BIGINT) AS missing_result FROM u GROUP BY field""")
def field_status_matrix(spark: SparkSession, d: str) -> DataFrame:
    long = _statuses(spark, d).unpivot("doc", ["name", "article", "price"], "field", "status")
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return long.groupBy("field").agg(n("OK").alias("ok"), n("FAIL").alias("fail"), n("MISSING_REF").alias("missing_ref"), n("MISSING_RESULT").alias("missing_result"))


@query("", _SIDES + r""", n AS (SELECT doc, idx, name, article, lead(name) OVER w AS name2, lead(article) OVER w AS article2, lead(idx) OVER w AS nxt FROM refs WINDOW w AS (PARTITION BY doc ORDER BY idx)),
 h AS (SELECT DISTINCT n.doc, n.idx AS first_idx, s.idx AS result_idx, lower(trim(n.name || ' ' || coalesce(n.name2, ''))) AS x, lower(s.name) AS y FROM n JOIN results s ON s.doc = n.doc AND (s.article = n.article OR s.article = n.article2) WHERE nxt IS NOT NULL)
 SELECT doc, first_idx, result_idx, floor((1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE)) * 1000 + 0.5) / 1000 AS similarity FROM h WHERE 1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) >= 0.8""")
def split_merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    return C.split_merge_clusters(*_sides(spark, d))


@query()
def score_documents_greedy(spark: SparkSession, d: str) -> DataFrame:
    ref, result = _sides(spark, d)
    return C.document_scores(C.greedy_assignment(ref, result), result).withColumn("status", C.monitor_status(F.col("score")))


@query()
def price_merge(spark: SparkSession, d: str) -> DataFrame:
    return C.confident_partners(*_sides(spark, d))


_DOUBLED = "SELECT doc, idx, name, article, price, quantity FROM refs WHERE doc % 3 = 0 UNION ALL SELECT doc, idx + 100, name, article, price * 1.2, quantity FROM refs WHERE doc % 3 = 0 AND idx % 4 <> 3"


@query("", f"WITH refs AS ({_REF}), x AS ({_DOUBLED})" + r""", p AS (SELECT a.doc, a.idx AS i, b.idx AS j FROM x a JOIN x b ON a.doc = b.doc AND a.idx < b.idx AND b.price > a.price AND a.price > 0 AND abs(b.price / a.price - 1.2) <= 0.015 AND a.article = b.article AND a.article <> ''),
 proof AS (SELECT doc FROM p GROUP BY doc HAVING count(DISTINCT i) >= 3 AND count(DISTINCT j) >= 3), q AS (SELECT * FROM p WHERE doc IN (SELECT doc FROM proof))
 SELECT doc, idx, CASE WHEN (doc, idx) IN (SELECT (doc, i) FROM q) THEN price * 1.2 ELSE price END AS price FROM x WHERE (doc, idx) NOT IN (SELECT (doc, j) FROM q) AND article IS NOT NULL""")
def vat_duplicate_selfjoin(spark: SparkSession, d: str) -> DataFrame:
    """Documents that list their goods twice, without and with tax, by article alone: the rows have no names here."""
    ref, _ = _sides(spark, d)
    x = ref.where("doc % 3 = 0").selectExpr("doc", "idx", "CAST(NULL AS STRING) AS name", "article", "price", "quantity")
    x = x.unionByName(x.where("idx % 4 <> 3").selectExpr("doc", "idx + 100 AS idx", "name", "article", "price * 1.2D AS price", "quantity"))
    return C.without_vat_duplicates(x.where("article IS NOT NULL")).select("doc", "idx", "price")


# --- feedback -------------------------------------------------------------------------


@query("", """SELECT coalesce(CAST(user_id AS VARCHAR), 'all') AS supplier, coalesce(event_type, 'any') AS kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS open, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS resolved FROM events GROUP BY ROLLUP (user_id, event_type)""")
def feedback_breakdown(spark: SparkSession, d: str) -> DataFrame:
    t = A.read(spark, d, "events").withColumn("status", F.expr("CASE WHEN event_id % 3 = 0 THEN 'resolved' WHEN event_id % 3 = 1 THEN 'new' END"))
    open_ = F.coalesce("status", F.lit("new")) == "new"
    g = t.rollup("user_id", "event_type").agg(F.count("*").alias("n"), F.count(F.when(open_, 1)).alias("open"), F.count(F.when(~open_, 1)).alias("resolved"))
    return g.select(F.coalesce(F.col("user_id").cast("string"), F.lit("all")).alias("supplier"), F.coalesce("event_type", F.lit("any")).alias("kind"), "n", "open", "resolved")


@query("", "SELECT event_id, CASE event_type WHEN 'click' THEN 'press' WHEN 'view' THEN 'look' ELSE event_type END AS label, event_type LIKE 'p%' OR event_type = 'click' AS tagged, CAST(date_diff('day', CAST(ts AS DATE), DATE '2030-01-01') AS INT) AS age, CAST(ts AS DATE) >= DATE '2024-01-15' AND value >= 20 AS recent FROM events")
def feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    label = F.coalesce(F.create_map(*map(F.lit, ("click", "press", "view", "look")))[F.col("event_type")], F.col("event_type"))
    t = A.read(spark, d, "events")
    return t.select("event_id", label.alias("label"), (F.col("event_type").like("p%") | (F.col("event_type") == "click")).alias("tagged"), F.datediff(F.lit("2030-01-01").cast("date"), F.to_date("ts")).alias("age"), ((F.to_date("ts") >= F.lit("2024-01-15").cast("date")) & (F.col("value") >= 20)).alias("recent"))


@query("", "SELECT event_id, sha256(coalesce(props, '')) AS content, sha256(coalesce(props, '') || '|' || event_type) AS cache_key, CAST(floor(epoch(ts)) AS BIGINT) + 2592000 AS expires FROM events")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    t = A.read(spark, d, "events")
    props = F.coalesce("props", F.lit(""))
    return t.select("event_id", F.sha2(props, 256).alias("content"), F.sha2(F.concat(props, F.lit("|"), F.col("event_type")), 256).alias("cache_key"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + 2592000).alias("expires"))


# --- feedback by supplier -----------------------------------------------------------------

_FEEDBACK = "SELECT CASE l_linenumber % 5 WHEN 0 THEN 'reject' WHEN 1 THEN ' tag_price ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'confirm' END AS type, CASE l_suppkey % 3 WHEN 0 THEN 'price_list' WHEN 1 THEN 'invoice' END AS source, CASE l_partkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'new' END AS status, l_shipdate AS created_at, CASE WHEN l_linenumber % 4 = 0 THEN l_suppkey END AS supplier_id, l_orderkey AS invoice_item_id, l_partkey AS price_list_item_id FROM"
_DOCUMENTS = {
    "invoice_items": "SELECT o_orderkey AS id, o_orderkey AS invoice_id FROM {orders}", "invoices": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 120 END AS supplier_id FROM {orders}",
    "list_items": "SELECT p_partkey AS id, p_partkey % 50 AS list_id FROM {part} WHERE p_partkey % 7 <> 0", "lists": "SELECT DISTINCT p_partkey % 50 AS id, p_partkey % 50 + 1 AS supplier_id FROM {part}",
    "sellers": "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE s_name END AS name FROM {supplier}",
}


@query(sql="WITH " + ", ".join(f"{n} AS ({v.format(orders='orders', part='part', supplier='supplier')})" for n, v in _DOCUMENTS.items()) + f""", f AS ({_FEEDBACK} lineitem), s AS (
  SELECT coalesce(nullif(trim(w.name), ''), 'Без поставщика') AS supplier, coalesce(nullif(trim(f.type), ''), 'unknown') AS error_type, CASE WHEN status = 'resolved' THEN 'resolved' ELSE 'new' END AS state, created_at FROM f
  LEFT JOIN invoice_items ii ON coalesce(f.source, 'invoice') = 'invoice' AND ii.id = f.invoice_item_id LEFT JOIN invoices i ON i.id = ii.invoice_id LEFT JOIN list_items li ON f.source = 'price_list' AND li.id = f.price_list_item_id LEFT JOIN lists l ON l.id = li.list_id LEFT JOIN sellers w ON w.id = coalesce(f.supplier_id, i.supplier_id, l.supplier_id))
 SELECT supplier, error_type, count(*) AS error_count, count(*) FILTER (state = 'new') AS new_count, count(*) FILTER (state = 'resolved') AS resolved_count FROM s WHERE CAST(created_at AS DATE) >= DATE '1995-06-01' GROUP BY GROUPING SETS ((supplier, error_type), (supplier))""")
def feedback_by_supplier(spark: SparkSession, d: str) -> DataFrame:
    """Feedback since a day by supplier and kind, with each supplier's total; the supplier is the feedback's own, its invoice's or its price list's."""
    tables = {n: A.read(spark, d, n) for n in ("orders", "part", "supplier")}
    documents = [spark.sql(v, **{n: t for n, t in tables.items() if "{" + n + "}" in v}) for v in _DOCUMENTS.values()]
    feedback = spark.sql(_FEEDBACK + " {lines}", lines=A.read(spark, d, "lineitem"))
    return B.breakdown(B.with_suppliers(feedback, *documents), "1995-06-01")


# --- the tax of a document --------------------------------------------------------------

_SAID = "CASE spec_id % 11 WHEN 0 THEN 'Работает по УСН' WHEN 1 THEN 'Итого без НДС' WHEN 2 THEN 'НДС не облагается' WHEN 3 THEN 'в том числе НДС 20%' WHEN 4 THEN 'В т.ч. НДС 10 %' WHEN 5 THEN 'Цена с учётом НДС' WHEN 6 THEN 'ставка 10' WHEN 7 THEN 'ндс 20' WHEN 8 THEN 'УСНОВА' ELSE 'Счёт на оплату' END"
_KIND = "CASE spec_id % 4 WHEN 0 THEN 'with_vat' WHEN 1 THEN 'total_with_vat' WHEN 2 THEN 'without_vat' ELSE 'unclear' END"


@query("named", f""", x AS (SELECT spec_id, lower({_SAID}) AS t, {_KIND} AS kind, CASE WHEN spec_id % 13 = 0 THEN NULL ELSE CAST(spec_id % 97 AS DOUBLE) END AS price, quantity, CASE WHEN spec_id % 5 = 0 THEN 3.0 END AS tax FROM named),
 v AS (SELECT *, regexp_matches(t, '(^|[^а-яё])усн($|[^а-яё])|не облагается|без ндс|ндс\\s*не') AS free, CASE WHEN regexp_matches(t, '20\\s*%|ставка\\s*20|ндс\\s*20') THEN 20 WHEN regexp_matches(t, '10\\s*%|ставка\\s*10') THEN 10 END AS named_rate FROM x)
 SELECT spec_id, CAST(CASE WHEN free THEN 0 ELSE coalesce(named_rate, 20) END AS INT) AS rate, free OR regexp_matches(t, 'в\\s+том\\s+числе\\s+ндс|в\\s*т\\s*\\.?\\s*ч\\s*\\.?\\s*ндс|с\\s+уч[её]том\\s+ндс') AS included,
  floor(1000 * CASE WHEN free OR kind = 'with_vat' THEN price WHEN kind = 'total_with_vat' THEN CASE WHEN quantity > 0 AND price > 0 THEN price / quantity ELSE price END WHEN price = 0 THEN NULL WHEN kind = 'without_vat' AND tax > 0 AND quantity > 0 THEN (price * quantity + tax) / quantity WHEN named_rate = 10 THEN price * 1.1 ELSE price * 1.2 END + 0.5) / 1000 AS price,
  coalesce(price > 0 AND NOT free AND kind = 'unclear' AND named_rate IS NULL, false) AS doubtful FROM v""")
def document_tax(spark: SparkSession, d: str) -> DataFrame:
    """The tax that documents' texts name, and unit prices with it inside by the kind of their column."""
    x = A.named(spark, d).selectExpr("spec_id", f"{_SAID} AS said", f"{_KIND} AS kind", "CASE WHEN spec_id % 13 = 0 THEN NULL ELSE CAST(spec_id % 97 AS DOUBLE) END AS price", "quantity", "CASE WHEN spec_id % 5 = 0 THEN 3.0D END AS tax").withColumn("vat", D.document_vat(F.col("said")))
    p = x.withColumn("p", D.price_with_vat(F.col("price"), F.col("quantity"), F.col("tax"), F.col("kind"), F.col("vat")))
    return p.select("spec_id", "vat.rate", "vat.included", (F.floor(F.col("p.price") * 1000 + 0.5) / 1000).alias("price"), F.coalesce(F.col("p.how") == "doubtful", F.lit(False)).alias("doubtful"))
