"""Text extraction as Column expressions. Patterns carry (?U) so that blanks and word characters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeframe.config import RULES
from placeframe.functions.numeric import _c, acres, floor_area

# What listings are recognised by.
POSTCODE = r"\b([A-Z]{1,2}\d[A-Z\d]?)\s*(\d[A-Z]{2})\b"
PRICE = (
    r"(?iU)(offers over|offers around|offers in the region of|offers in excess of|fixed price|oieo|oiro|o/o|"
    r"price on application|from)?\s*£\s?(\d{1,3}(?:,\d{3})+|\d{5,})"
)
BEDS = r"(?iU)\b(\d{1,2})\s*(?:-|\s)?\s*(?:bed(?:room)?s?)\b"
BEDS_WORD = r"(?iU)\b(one|two|three|four|five|six|seven|eight)[\s-]+bed(?:room)?s?\b"
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8}
BATHS = r"(?iU)\b(\d{1,2})\s*(?:-|\s)?\s*bath(?:room)?s?\b"
BATHS_LABEL = r"(?iU)\bbathrooms\s*:?\s*(\d{1,2})\b(?!\s*(?:\.\d|x|m\b))"
DETACHED = r"(?iU)(?<!semi)(?<!semi-)(?<!semi )\bdetached\b"
OTHER_TYPE = r"(?i)semi|terrace|flat|apartment|maisonette"
GARAGE = r"(?iU)\bgarag(e|es|ing)\b"
NOT_GARAGE = r"(?iU)\b(no|without)\s+(a\s+)?garag"
AREA_UNIT = r"(m²|m2|sq\.?\s?m(?:etres|eters)?\b|square\s+met(?:re|er)s|sq\.?\s?ft\b|square\s+f(?:ee|oo)t|ft²)"
AREA_NUMBER = r"(?<![\d,.])(\d{1,3}(?:,\d{3})+|\d{2,5})(?:\.\d+)?"
AREA_ANY = rf"(?iU){AREA_NUMBER}\s*{AREA_UNIT}"
AREA_LABELLED = rf"(?iU)(?:floor\s*area|internal\s*area|total\s*area|living\s*area|floor\s*space|size)[^\d]{{0,40}}?{AREA_NUMBER}\s*{AREA_UNIT}"
EPC_BAND = r"(?i)^\s*(?:band\s*)?([A-G])\b"
EPC_TEXT = r"(?U)\bEPC(?:\s+(?i:rating))?\s*[:\-]?\s*(?:(?i:band)\s*)?([A-G])\b(?![\w'])"
MOTIVATED = (
    r"(?iU)heritable creditors?|repossess\w*|lender in possession|executry|executors? of|on behalf of the executor|"
    r"trustees? in sequestration|sequestrat\w*|\breceivers?\b|power of sale|sold as seen|cash buyers? only|"
    r"suited to cash buyers|priced for (?:a )?quick sale"
)
NEEDS_WORK = (
    r"(?iU)(?:require|requires|requiring|in need of|would benefit from|scope for)\s+(?:some\s+|full\s+|complete\s+|general\s+|"
    r"extensive\s+|a programme of\s+)?(?:modernisation|modernization|refurbishment|renovation|upgrading|updating|repair)|"
    r"renovation project|refurbishment project|restoration project|project property|development opportunity|doer[- ]upper|"
    r"in need of (?:some )?(?:tlc|work)"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = "|".join(MONTHS)
CLOSING = (
    rf"(?iU)closing date[^.\d]{{0,40}}?(?:(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?\s+({MONTH_NAMES})\w*,?(?:\s+(\d{{4}}))?|"
    r"(\d{1,2})[/.](\d{1,2})[/.](\d{2,4}))"
)
TYPE_WORDS = ("semi-detached", "detached", "terraced", "end-terrace", "mid-terrace", "villa", "bungalow", "cottage", "flat", "apartment", "maisonette", "townhouse", "house", "duplex")
EXCLUDED_TYPES = r"(?iU)\b(flat|apartment|maisonette|penthouse|duplex|studio|retirement)\b"
RENTAL = r"(?iU)\bto (rent|let)\b"
PLOT_WORDS = (
    r"(?iU)\b(?:building plots?|plots? of land|plots?|land|site|development (?:site|opportunity|plot|with)|"
    r"planning (?:permission|consent)|self[- ]build|woodland|paddock)\b"
)
PLOT_FOR_SALE = r"(?iU)\b(?:plots?|land|site)\s+for sale|building plot|plots? of land|with (?:full |outline |detailed )?planning|self[- ]build"
PLOT_SIZE = r"(?iU)(\d+(?:\.\d+)?)\s*(acres?|hectares?|ha)\b"
PROPERTY_PATH = r"(?i)/property/[a-z0-9][a-z0-9\-/]*?(\d{5,})/?(?=[\"'?#\s]|$)"
SLUG_POSTCODE = r"(?i)-([a-z]{1,2}\d[a-z\d]?)-(\d[a-z]{2})(?:/|$)"
NOT_A_HOME = r"(?iU)\b(?:lock-?up|garage site|ground rent|feu duty|retail unit|shop unit|office)\b"
TITLE_NOISE = (
    r"(?iU)^(?:future\s+)?auction details\s*-\s*|^property for auction in scotland\s*-\s*|"
    r"\s*-?\s*(?:guide|opening bid|starting bid)\b.*$|\s*\|.*$"
)
ADDRESS_NOISE = (
    r"(?isU)^(?:future\s+)?auction details\s*-\s*|^property for auction in scotland\s*-\s*|"
    r"\s*-?\s*(?:guide price|guide|opening bid|starting bid)\b.*$"
)
PRICE_BASIS = r"(?iU)(opening bid|starting bid|guide price|guide|reserve price)\s*(?:of|is|from)?\s*[:\-]?\s*\*?\s*£\s?(\d{1,3}(?:,\d{3})+|\d{4,})"
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
LINK = r"""(?i)(?:href=|"url"\s*:\s*|"link"\s*:\s*)["']([^"']*/property/[^"']+)["']"""


def extract(text, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(_c(text), pattern, group), F.lit(""))


def whole_number(text) -> Column:
    return F.replace(_c(text), F.lit(","), F.lit("")).try_cast("int")


def listing_id(url) -> Column:
    return extract(F.try_parse_url(_c(url), F.lit("PATH")), PROPERTY_PATH)


def slug_district(url) -> Column:
    """District in the last part of a listing's path, '...-eh28-8aw/36392542'."""
    path = F.rtrim(F.coalesce(F.try_parse_url(_c(url), F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.upper(extract(F.concat(F.regexp_replace(path, r"/\d{5,}$", ""), F.lit("/")), SLUG_POSTCODE))


def absolute_url(base, link) -> Column:
    """A link against its page: absolute, protocol-relative, rooted or relative; the fragment goes."""
    link, base = F.regexp_replace(_c(link), "#.*$", ""), _c(base)
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    folder = F.when(F.regexp_replace(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*", "").rlike("/"), F.regexp_extract(base, r"^([^?#]*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^(\w+:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), link)).otherwise(F.concat(folder, link))


def property_links(html) -> Column:
    """All listing links of a page, in order; links within embedded JSON are unescaped."""
    return F.regexp_extract_all(F.replace(_c(html), F.lit("\\/"), F.lit("/")), F.lit(LINK), F.lit(1))


def title_case(text) -> Column:
    """A capital after everything that is no letter, small letters elsewhere: an apostrophe or slash begins a word."""
    runs = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def page_title(html) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1), r"(?U)\s+", " "))


def recognised_location(html) -> Column:
    title = page_title(html)
    return (title == "") | title.rlike(r"(?iU)\bfor sale in \w")


def price_parts(head, text) -> tuple[Column, Column]:
    """Price and qualifier (capitalised) of the headline, else of the page."""
    own = _c(head).rlike(PRICE)
    pick = lambda g: F.when(own, extract(head, PRICE, g)).otherwise(extract(text, PRICE, g))
    return whole_number(pick(2)), title_case(pick(1))


def number_word(word) -> Column:
    return F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])[F.lower(_c(word))]


def bedrooms(*texts) -> Column:
    """Digits in any of the texts first, then number words."""
    return F.coalesce(*[extract(t, BEDS).cast("int") for t in texts], *[number_word(extract(t, BEDS_WORD)) for t in texts])


def bathrooms(*texts) -> Column:
    one = lambda t: F.coalesce(extract(t, BATHS), extract(t, BATHS_LABEL)).cast("int")
    return F.coalesce(*[F.when(one(t).between(1, 14), one(t)) for t in texts])


def areas_in(text, pattern: str) -> Column:
    """The first plausible floor area that a pattern finds."""
    numbers, units = F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(1)), F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(2))
    return F.try_element_at(F.filter(F.zip_with(numbers, units, lambda n, u: floor_area(n, u)), lambda a: a.isNotNull()), F.lit(1))


def stated_area(own, text) -> Column:
    """A labelled figure, else any in the listing's own words, else any on the page."""
    return F.coalesce(areas_in(F.concat_ws(" ", _c(own), _c(text)), AREA_LABELLED), areas_in(own, AREA_ANY), areas_in(text, AREA_ANY))


def postcode(*texts) -> Column:
    return F.coalesce(*[F.when(_c(t).rlike(POSTCODE), F.concat_ws(" ", F.regexp_extract(_c(t), POSTCODE, 1), F.regexp_extract(_c(t), POSTCODE, 2))) for t in texts])


def district(code) -> Column:
    return F.split(F.upper(_c(code)), r"\s+")[0]


def is_detached(type_text, description) -> Column:
    return _c(type_text).rlike(DETACHED) | (~_c(type_text).rlike(OTHER_TYPE) & F.substring(_c(description), 1, 300).rlike(DETACHED))


def has_garage(text) -> Column:
    return _c(text).rlike(GARAGE) & ~_c(text).rlike(NOT_GARAGE)


def flags(text) -> Column:
    return F.array_compact(F.array(F.when(_c(text).rlike(MOTIVATED), "motivated"), F.when(_c(text).rlike(NEEDS_WORK), "needs_work")))


def epc_band(prop, text) -> Column:
    return F.upper(F.coalesce(extract(prop, EPC_BAND), extract(text, EPC_TEXT)))


def plot_acres(text) -> Column:
    return acres(extract(text, PLOT_SIZE, 1), extract(text, PLOT_SIZE, 2))


def month_number(name) -> Column:
    key = F.lower(F.substring(_c(name), 1, 3))
    return F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, i)])[key]


def try_day(year, month, day) -> Column:
    """A date from its parts; null for days that do not exist."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", _c(year), _c(month), _c(day)), "yyyy-MM-dd")


def closing_date(text, as_of) -> Column:
    """A set closing date; a day without a year more than 60 days gone is next year's."""
    part = lambda i: extract(text, CLOSING, i)
    today = _c(as_of).cast("date")
    day, month, year = part(1).cast("int"), month_number(part(2)), part(3).cast("int")
    named = try_day(F.coalesce(year, F.year(today)), month, day)
    later = F.when(year.isNull() & (named < F.date_sub(today, 60)), try_day(F.year(today) + 1, month, day)).otherwise(named)
    short = part(6).cast("int")
    numeric = try_day(F.when(short < 100, short + 2000).otherwise(short), part(5).cast("int"), part(4).cast("int"))
    return F.when(day.isNotNull(), later).when(short.isNotNull(), numeric)


def price_and_basis(text) -> tuple[Column, Column]:
    word = F.lower(extract(text, PRICE_BASIS, 1))
    basis = F.when(word.rlike("opening|starting"), "Opening bid").when(word.contains("reserve"), "Reserve").when(word.isNotNull(), "Guide price")
    return whole_number(extract(text, PRICE_BASIS, 2)), basis


def lot_id(url) -> Column:
    """One id for all pages of a lot: host and number, else a digest of the URL."""
    host = F.split(F.replace(F.coalesce(F.try_parse_url(_c(url), F.lit("HOST")), F.lit("")), F.lit("www."), F.lit("")), r"\.")[0]
    number = F.coalesce(extract(url, r"(?i)[?&](?:id|lotid|propertyid)=(\d+)"), extract(url, r"(?i)/lots?/(\d+)"))
    return F.when(number.isNotNull(), F.concat(F.lit("auc-"), host, F.lit("-"), number)).otherwise(F.concat(F.lit("auc-"), F.substring(F.sha1(_c(url).cast("binary")), 1, 12)))


def clean_title(title) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(_c(title), F.lit("")), r"(?U)\s+", " "))
    for _ in range(3):
        t = F.btrim(F.regexp_replace(t, TITLE_NOISE, ""), F.lit(" -"))
    return t


def strip_address_noise(address) -> Column:
    return F.regexp_replace(F.coalesce(_c(address), F.lit("")), ADDRESS_NOISE, "")


def is_plot(text, beds=None) -> Column:
    words = F.coalesce(_c(text).rlike(PLOT_WORDS), F.lit(False))
    return words if beds is None else words & (_c(beds).isNull() | _c(text).rlike(PLOT_FOR_SALE))


def rejection(title, kind, beds, dist, beds_required: bool = True, rules=RULES) -> Column:
    """Why a listing is not wanted, null where it is: rental, plot's district, type, bedrooms, district, in this order."""
    text = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(kind), F.lit("")))
    beds, dist = _c(beds), _c(dist)
    far = (F.coalesce(dist, F.lit("")) != "") & ~dist.isin(list(rules.districts))
    place = F.when(far, F.concat(F.lit("district "), dist))
    out = F.when(text.rlike(RENTAL), "rental").when(is_plot(text, beds), place).when(text.rlike(EXCLUDED_TYPES), "flat")
    if beds_required:
        out = out.when(beds.isNull(), "bedrooms unknown")
    return out.when(beds < rules.min_bedrooms, F.concat(beds.cast("string"), F.lit(" bedroom"))).otherwise(place)


def prefilter(url, hint, rules=RULES) -> Column:
    """A reason that the results page alone gives: the URL's district, then the card's text."""
    d = slug_district(url)
    far = d.isNotNull() & ~d.isin(list(rules.districts))
    card = rejection(hint, F.lit(""), extract(hint, BEDS).cast("int"), F.lit(None).cast("string"), beds_required=False, rules=rules)
    return F.when(far, F.concat(F.lit("district "), d)).when(F.coalesce(_c(hint), F.lit("")) != "", card)


def lot_prefilter(hint, rules=RULES) -> Column:
    card = rejection(F.substring(_c(hint), 1, 300), F.lit(""), bedrooms(hint), extract(F.upper(_c(hint)), POSTCODE), beds_required=False, rules=rules)
    return F.when(F.coalesce(_c(hint), F.lit("")) == "", F.lit(None)).when(F.substring(_c(hint), 1, 200).rlike(NOT_A_HOME), "not a home or plot").otherwise(card)


def house_type(kind, detached) -> Column:
    t = F.lower(F.coalesce(_c(kind), F.lit("")))
    return F.when(t.contains("semi"), "semi").when(t.rlike(r"\bdetached\b") | F.coalesce(_c(detached), F.lit(False)), "detached").when(t.rlike("terrace|mews"), "terraced").when(t.rlike(r"town\s?house"), "townhouse").when(t.rlike("cottage|bungalow"), "cottage").otherwise("other")


def school_key(name) -> Column:
    """A school's name without what registers write differently."""
    n = F.replace(F.lower(_c(name)), F.lit("’"), F.lit("'"))
    return F.trim(F.regexp_replace(F.regexp_replace(n, r"(?U)\b(?:primary|school|rc|nd|the|ps)\b|\bp\.(?=\s|$)", " "), "[^a-z0-9]+", " "))


def tidy_school(name) -> Column:
    """Blanks squeezed; all-capital names in title case."""
    n = F.trim(F.regexp_replace(_c(name), r"(?U)\s+", " "))
    return F.when((n == F.upper(n)) & (n != F.lower(n)), title_case(n)).otherwise(n)


def primary_name(school, note) -> tuple[Column, Column]:
    """(school, stages) of a primary catchment from the register's name and its note."""
    stages_rx = r"(?i)^For (P\d\s*-\s*P\d) Pupils Only\s*-\s*(.+)"
    note = F.coalesce(_c(note), F.lit(""))
    outlying = extract(note, r"(?i)have (.+?) as their catchment")
    stages = F.upper(F.regexp_replace(extract(note, stages_rx, 1), r"\s+", ""))
    raw = F.coalesce(extract(note, stages_rx, 2), outlying, F.nullif(F.trim(F.coalesce(_c(school), F.lit(""))), F.lit("")), F.lit("Unknown"))
    return F.regexp_replace(tidy_school(F.regexp_replace(raw, r"^X\s+", "")), r"\s+School$", ""), stages


def escape_html(text) -> Column:
    """Text for a page: the five characters that mark-up gives a meaning to; null as nothing."""
    out = F.coalesce(_c(text).cast("string"), F.lit(""))
    for char, entity in HTML_ENTITIES:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def route_label(name) -> Column:
    tail = extract(name, r":\s*(.+)$")
    return F.when(tail.isNotNull(), F.replace(tail, F.lit("=>"), F.lit("↔"))).otherwise(_c(name))


def route_name(short, long, route_id, kind) -> Column:
    return F.when(_c(kind).cast("string") == "0", "Tram").otherwise(F.coalesce(F.nullif(_c(short), F.lit("")), F.nullif(_c(long), F.lit("")), _c(route_id)))


def route_order(ref) -> Column:
    """Numbered routes first by number and suffix, then the others by name."""
    number = extract(ref, r"^(\d+)").cast("long")
    return F.struct(number.isNull().cast("int").alias("text"), F.coalesce(number, F.lit(0)).alias("n"), F.when(number.isNull(), _c(ref)).otherwise(F.regexp_extract(_c(ref), r"^\d+(.*)", 1)).alias("rest"))


def district_order(d) -> list[Column]:
    """Two letters, then the number (0 without one)."""
    return [F.substring(_c(d), 1, 2), F.coalesce(F.regexp_replace(F.substring(_c(d), 3, 20), r"\D", "").try_cast("int"), F.lit(0))]


def relation_lines(members) -> Column:
    """Lines of a route relation: its ways with geometry in a running role, as arrays of (x, y)."""
    ways = F.filter(_c(members), lambda m: (m["type"] == "way") & m["geometry"].isNotNull() & F.coalesce(m["role"], F.lit("")).isin("", "forward", "backward", "main"))
    return F.transform(ways, lambda m: F.transform(m["geometry"], lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y"))))
