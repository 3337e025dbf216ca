"""Abbreviations, markers and patterns of Russian decrees, addresses and school names.

Java patterns; (?U) gives \\d, \\s, \\w and \\b their Unicode meaning.
"""

STREET_TYPE = (
    r"(?iuU)\b(улица|ул\.?|проспект|просп\.?|пр-кт|пр-т|пр\.?|переулок|пер\.?|проезд|пр-д|бульвар|б-р|шоссе|ш\.?|набережная|наб\.?|площадь|пл\.?"
    r"|тупик|туп\.?|аллея|линия|тракт|дорога|дор\.?|квартал|кв-л|микрорайон|мкр\.?|мкрн\.?)\b\.?"
)
REGION = r"^[а-яё\- ]+\s+(обл|область|край|респ|республика)[.,]?\s*"
LOCALITY_WORDS = (
    "городской округ", "город. округ", "г.о.", "г.о", "муниципальный округ", "муниципальный район", "поселение", "пгт", "посёлок", "поселок",
    "село", "деревня", "город", "г.", "пос.", "с.", "д.", "п.", "обл.", "обл",
)
PARITIES = ("all", "even", "odd", "mixed", "unknown")
RULE_TYPES = ("all", "exact_list", "range", "up_to", "from_to_end", "all_except", "intersection_segment", "mixed", "unknown")
ALL_HOUSES = ("все", "все дома")

FROM_HOUSE = r"(?U)(начиная с|от дома|от)\s*(?:дома|д\.)?\s*(\d+)"
UP_TO_HOUSE = r"(?U)до\s*(?:дома|д\.)?\s*(\d+)"
EXCEPT_HOUSES = r"(?U)кроме\s*(?:домов|дома|д\.)?\s*([\d,\sа-яА-Яa-zA-Z/]+)"
HOUSE_RANGE = r"(?U)(\d+)\s*[-–]\s*(\d+)"
HOUSE_TOKEN = r"(?U)\d+[а-яА-Яa-zA-Z]?(?:/\d+)?"
WHOLE_RANGE = r"(?U)^\s*(\d+)\s*[-–]\s*(\d+)\s*$"
ALIAS = r"(?sU)^(.+?)\s*\(([^)]+)\)\s*$"

PART_STREET = r"(?iuU)\b(улица|ул|проспект|пр-кт|пр-т|просп|пр|шоссе|ш|бульвар|б-р|переулок|пер|проезд|пр-д|набережная|наб|площадь|пл|тупик|туп|аллея|линия|тракт)\b\.?"
PART_DISTRICT = r"(?iuU)\b(мкр|мкрн|микрорайон|квартал|кв-л)\b\.?"
PART_LOCALITY = r"(?iuU)\b(г|город|пос|посёлок|поселок|с|село|д|деревня|пгт)\b\.?"
PART_HOUSE = r"(?iuU)\b(д|дом|строение|стр|корп|корпус)\b\.?"
PART_REGION = r"(?iuU)\b(обл|область|край|респ|республика)\b\.?"
BARE_HOUSE = r"(?U)^\d+[а-яa-z]?(?:[/\-к]\d+)?$"
TRAILING_HOUSE = r"(?iuU)\s+(\d+[а-яa-z]?(?:[/\-к]\d+)?)\s*$"

SCHOOL_NAME = r"(?iu)«[^»]*(?:школа|школа-интернат|прогимназия|гимназия|лицей|СОШ|НОШ|ООШ)[^»]*»"
SCHOOL_PREFIX = r"(?iuU)^\s*(Муниципальн|Государственн|МБОУ|МАОУ|МОУ|МКОУ|МАУ|ГБОУ|ГАОУ|ГОУ|ГКОУ|АНО|АНОО|ОАНО|ЧОУ|НОУ|СОШ|НОШ|ООШ)"
NAME_CONTINUATION = r"(?iuU)^\s*(Городск(ого|ой)|«)"
TERRITORY_MARKER = (
    r"(?iuU)\b(ул\.|пр-кт|пр-т|пр\.|просп\.|проспект|шоссе|ш\.|пер\.|переулок|проезд|пр-д|бульвар|б-р|наб\.|набережная|дор\.|дорога|тракт|аллея|площадь|пл\.|тупик"
    r"|мкр\.|мкрн\.|мкрн|микрорайон|квартал|кв-л|тер\.|территория|линия|просек|просека|городок|д\.|с\.|п\.|г\.|ст\.|пос\.|деревня|село|посёлок|поселок|станция"
    r"|СНТ|ТСН|ДНП|ДНТ|ДНС|ДПК|КП|ЖК|ЖСК|ЖСТ|СПО|ПК\s*СТ|ПО\s*СТ|СТ\s|дом\s+\d|д\.\s*\d)"
)
HEADER_MARKERS = ("наименование", "номер дома", "номер\nдома", "территория", "адрес", "улица", "п/п")
TWO_COLUMN_MARKERS = ("территор", "улиц", "адрес", "закрепл")
NOT_STREETS = ("улица", "ул.", "район", "—", "-")
SCHOOL_SPLIT = (
    r"(?U)(?=Муниципальн(?:ое|ому|ого)\s+(?:бюджетн|автономн|казённ|казенн)|Государственн(?:ое|ому|ого)\s+(?:бюджетн|автономн|казённ|казенн)"
    r"|\b(?:МБОУ|МАОУ|МОУ|МКОУ|ГБОУ|ГАОУ|ГОУ|ГКОУ|АНО|АНОО|ОАНО|ЧОУ|НОУ)\b)"
)
TERRITORY_SPLIT = r"(?=мкр\.|мкрн|микрорайон|ул\.|пр-кт|пр-т|проспект|шоссе|д\.|с\.|п\.|г\.|пер\.|проезд|бульвар|б-р|квартал|тер\.|территория|СНТ|ТСН|ДНП|ДНТ|ДПК|КП|ЖК|ЖСК)"

TERRITORY_STREET = (
    r"(?iuU)(?:улица|ул\.|проспект|просп\.|пр-кт|пр-т|пр\.(?=\s+[А-ЯЁ])|шоссе|ш\.(?=\s+[А-ЯЁ])|бульвар|б-р|переулок|пер\.|проезд|пр-д|набережная|наб\.|площадь"
    r"|пл\.(?=\s+[А-ЯЁ])|тупик|туп\.|аллея|линия|тракт)\s+([\dА-ЯЁ][\dА-ЯЁа-яё\-\s\.]*?)(?=,|\(|;|\.\s|\.$|$)"
)
MKR_PREFIX = r"(?iuU)мкр\.?\s+[А-ЯЁа-яё\-\d ]+?\s*:"
SECTION = r"(?U)\n\s*(\d+(?:\.\d+)?\.)\s*\n"

DECREE_NUMBER = r"(?iuU)(?:№|N)\s*([\d]+(?:[\-/.][\dА-Яа-я]+)*)"
DATE_NUMERIC = r"(?U)\b(\d{1,2})[.\s/-](\d{1,2})[.\s/-](\d{2,4})\b"
DATE_TEXT = r"(?iuU)\b(\d{1,2})\s+(январ\w*|феврал\w*|март\w*|апрел\w*|ма[йя]|июн\w*|июл\w*|август\w*|сентябр\w*|октябр\w*|ноябр\w*|декабр\w*)\s+(\d{4})"
#: Month stems in the order in which they are tried.
MONTHS = (("январ", 1), ("феврал", 2), ("март", 3), ("апрел", 4), ("ма", 5), ("июн", 6), ("июл", 7), ("август", 8), ("сентябр", 9), ("октябр", 10), ("ноябр", 11), ("декабр", 12))
MUNICIPALITY = r"(?U)(?iu:Городск(?:ой|ого)\s+округ(?:а)?|город(?:а|ского)?(?!\s+округ)|муниципальн\w+\s+(?:район(?:а)?|округ(?:а)?))\s+([А-ЯЁ][а-яё\-]+(?:\s+[А-ЯЁ][а-яё\-]+)?)"
FOREIGN_CONTEXT = r"(?iuU)\b(ФЗ|ФКЗ|РФ|закон|приказ|министерств|постановлени\w+\s+правительств|утративш\w+\s+силу|признать\s+утративш)"

BUILDING_MARKER = r"(?iuU)\bд\.\s*\d|\bкорп\.|\bстр\."
GEO_MARKER = r"(?iuU)\bг\.|город|посёлок|поселок|\bпос\."
TRANSIENT_MARKERS = ("timeout", "timed out", "429", "too many requests", "500", "502", "503", "504", "connection", "reset by peer", "disconnect", "ssl", "unexpected_eof", "handshake", "eof occurred", "protocol")

NO_NUMBER, NO_DATE, NO_MUNICIPALITY = "Без номера", "Без даты", "Неизвестный муниципалитет"
NO_STREET_FOUND = "DaData не нашла подходящую улицу"
NO_STREET_GIVEN = "DaData нашла адрес, но не вернула улицу"
STREET_CONFIRMED = "Улица подтверждена через DaData"
GAZETTEER_DOWN = "DaData недоступна: "
STREET_DIFFERS = "DaData предлагает другое написание: "
EMPTY_STREET = "У правила не указана улица"
EMPTY_HOUSES = "У правила пустое описание домов"
BAD_RANGE = "Некорректный диапазон: "
BAD_PARITY = "Неизвестная чётность: "
OVERLAP = "Пересечение правил по улице "
INCOMPLETE = "Адрес распознан не полностью. Укажите улицу и дом."
