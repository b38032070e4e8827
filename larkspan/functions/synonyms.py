"""Abbreviations of building names and what they stand for, replaced in one pass over a text."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.text import edged, let

# Abbreviation, full form and section, as the dictionary is filled at first.
_SEED = """
пэ | полиэтилен | общее
пэ-100 | полиэтилен | общее
пп | полипропилен | ВК
пвх | поливинилхлорид | ВК
вгп | водогазопроводная труба | ВК
эсв | электросварная | ВК
кш | кран шаровой | общее
кшз | кран шаровой запорный | общее
кш/з | кран шаровой запорный | общее
кз | клапан запорный | общее
ко | клапан обратный | общее
кпр | клапан приёмно-разборный | ВК
фк | фланцевый кран | ВК
нс | насосная станция | ВК
кнс | канализационная насосная станция | ВК
дкнс | дождевая канализационная насосная станция | ВК
итп | индивидуальный тепловой пункт | ОВ
цтп | центральный тепловой пункт | ОВ
тп | тепловой пункт | ОВ
учр | узел учёта расхода | ОВ
узр | узел запорно-регулирующий | ОВ
рр | регулирующий клапан | ОВ
клр | клапан регулирующий | ОВ
клп | клапан предохранительный | ОВ
клз | клапан запорный | ОВ
фкв | фильтр косой | ВК
фм | фильтр магнитный | ВК
фс | фильтр сетчатый | ВК
грв | грязевик вертикальный | ВК
грг | грязевик горизонтальный | ВК
ввг | кабель ввг | ЭО
пвс | провод пвс | ЭО
нг | негорючий | ЭО
ls | низкое дымовыделение | ЭО
lsltx | низкое дымовыделение | ЭО
пнр | пожарный кран | ВК
пк | пожарный кран | ВК
впв | внутренний противопожарный водопровод | ВК
рв | регистр вентиляционный | ОВ
кк | конвектор кассетный | ОВ
фн | фанкойл напольный | ОВ
фкн | фанкойл настенный | ОВ
вк | воздуховод круглый | ОВ
вп | воздуховод прямоугольный | ОВ
пбу | противопожарный блок устройств | ОВ
кпв | клапан противопожарный вентиляционный | ОВ
ок | отопительный контур | ОВ
гкл | гипсокартон | общее
гклв | влагостойкий гипсокартон | общее
ппу | пенополиуретан | общее
ппс | пенополистирол | общее
минвата | минеральная вата | общее
мв | минеральная вата | общее
пб | пенобетон | общее
жб | железобетон | общее
мон | монолитный | общее
сб | сборный | общее
ост | остекление | общее
ал | алюминиевый | общее
нерж | нержавеющая сталь | общее
нж | нержавеющая сталь | общее
оц | оцинкованный | общее
оцинк | оцинкованный | общее
чуг | чугун | общее
ст | сталь | общее
ст3 | сталь | общее
09г2с | сталь 09г2с | общее
гост | гост | общее
ту | технические условия | общее
шт | штука | общее
компл | комплект | общее
пог | погонный метр | общее
п.м | погонный метр | общее
пм | погонный метр | общее
тч | точка | общее
ед | единица | общее
куб.м | кубический метр | общее
м3 | кубический метр | общее
т.м | тонна | общее
тн | тонна | общее
кг | килограмм | общее
труба | труба | общее
отвод | отвод | общее
тройник | тройник | общее
переход | переход | общее
муфта | муфта | общее
заглушка | заглушка | общее
фланец | фланец | общее
резьба | резьбовое соединение | общее
пнд | полиэтиленовая труба | ВК
пвд | полиэтилен высокого давления | ВК
хвс | холодное водоснабжение | ВК
гвс | горячее водоснабжение | ВК
хгв | холодное и горячее водоснабжение | ВК
к1 | бытовая канализация | ВК
к2 | дождевая канализация | ВК
к3 | промышленная канализация | ВК
щр | щит распределительный | ЭО
що | щит освещения | ЭО
щс | щит силовой | ЭО
ще | щит этажный | ЭО
грщ | главный распределительный щит | ЭО
вру | вводное распределительное устройство | ЭО
ру | распределительное устройство | ЭО
авр | автоматическое включение резерва | ЭО
узо | устройство защитного отключения | ЭО
ав | автоматический выключатель | ЭО
диф | дифференциальный автомат | ЭО
узип | устройство защиты от импульсных перенапряжений | ЭО
контактор | контактор | ЭО
пускатель | магнитный пускатель | ЭО
кл | кабельная линия | ЭО
шр | шкаф распределительный | ЭО
рп | распределительный пункт | ЭО
ип | источник питания | ЭО
ибп | источник бесперебойного питания | ЭО
шввп | шнур шввп | ЭО
кабель-канал | кабель-канал | ЭО
лоток | кабельный лоток | ЭО
гофра | гофрированная труба | ЭО
ввгнг | кабель ввгнг | ЭО
кгн | кабель силовой гибкий | ЭО
аввг | кабель аввг | ЭО
пву | приточно-вытяжная установка | ОВ
пу | приточная установка | ОВ
ву | вытяжная установка | ОВ
рку | рекуператор | ОВ
кал | калорифер | ОВ
то | теплообменник | ОВ
рад | радиатор отопительный | ОВ
кон | конвектор | ОВ
вр | вентиляционная решётка | ОВ
др | диффузор | ОВ
глш | шумоглушитель | ОВ
кду | клапан дымоудаления | ОВ
кпу | клапан подпора воздуха | ОВ
козд | клапан огнезадерживающий | ОВ
гв | гибкая вставка | ОВ
нц | насос циркуляционный | ОВ
рб | расширительный бак | ОВ
терм | термометр | ОВ
ман | манометр | ОВ
балкл | балансировочный клапан | ОВ
задв | задвижка | общее
затв | затвор | общее
в1 | хозяйственно-питьевое водоснабжение | ВК
в2 | противопожарное водоснабжение | ВК
т3 | горячее водоснабжение | ВК
т4 | циркуляция гвс | ВК
лк | ливневая канализация | ВК
счв | счётчик воды | ВК
водомер | водомер | ВК
трап | трап канализационный | ВК
сиф | сифон | ВК
рев | ревизия | ВК
стояк | стояк | ВК
пп-р | полипропилен рандом-сополимер | ВК
мпт | металлопластиковая труба | ВК
обр.клап | обратный клапан | ВК
колодец | колодец | ВК
"""
SEED: tuple[tuple[str, str, str], ...] = tuple(tuple(line.split(" | ")) for line in _SEED.strip().splitlines())  # type: ignore[misc]


def any_word(words: Mapping[str, str] | list[str]) -> str:
    """One pattern that finds each of the words between its edges, the longest where several begin; words of one first letter share a branch, so that most places cost one look."""
    ordered = sorted(words, key=lambda w: (w[0], -len(w), w))
    branches = [f"(?={_letter(first)})(?:{'|'.join(edged(w) for w in some)})" for first, some in groupby(ordered, key=lambda w: w[0])]
    return f"(?iu)(?:{'|'.join(branches)})"


def _letter(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def expanded(text: Column, dictionary: Mapping[str, str]) -> Column:
    """Every word of the dictionary replaced by what it stands for: where several fit the longest, and what was put in is not looked at again.

    One search over the text and one look-up a find, however many words there
    are.  Case does not count; a null text stays null.
    """
    full = {a.strip().lower(): f.strip().lower() for a, f in dictionary.items() if a.strip()}
    if not full:
        return text
    pattern = any_word(full)
    table = F.create_map(*[F.lit(x) for pair in full.items() for x in pair])
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("words"), F.split(text, pattern, -1).alias("gaps"), table.alias("table"))
    joined = lambda x: F.array_join(F.zip_with(x["gaps"], x["words"], lambda gap, word: F.concat(gap, F.coalesce(F.try_element_at(x["table"], F.lower(word)), word, F.lit("")))), "")
    return F.when(text.rlike(pattern), let(found, joined)).otherwise(text)
