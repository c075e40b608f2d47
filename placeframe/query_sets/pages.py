"""Pages: listing and lot parsers, links and cards, over pages made of templates; and the crawls."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.functions import html as H
from placeframe.functions import variants as V
from placeframe.functions.dates import auction_day, dates_in
from placeframe.registry import answers, cases, literal, query, table, today
from placeframe.session import ship_package
from placeframe.sources import remote


#: A page of linked data, of application state, of meta tags and text, and of text alone. N and P stand for the part's number and price.
_LINKED = """<html><head><title>N Sample Road | Homes</title><script type="application/ld+json">{"@type": "House", "name": "4 bed detached house", "address": {"streetAddress": "N Sample Road", "addressLocality": "Leith", "postalCode": "EH4 1AB"},
"geo": {"latitude": 55.96, "longitude": "-3.25"}, "numberOfBedrooms": 4, "numberOfBathroomsTotal": "2", "floorSize": {"value": 1500, "unitCode": "FTK"}, "offers": [{"price": "P"}], "image": ["a.jpg"],
"additionalProperty": [{"name": "EPC rating", "value": "band c"}], "description": "A detached house with double garage, 0.5 acre."}</script></head><body><h1>Else</h1><p>Offers over £1,000,000. 9 bedrooms. Closing date: 10th October</p></body></html>"""
_STATE = """<html><head><title>Cottage N</title><script id="__NEXT_DATA__" type="application/json">{"props": {"a": [{"propertyType": "Terraced Cottage", "Beds": "3", "bathrooms": 1, "displayPrice": "£P", "lat": 55.9, "lng": -3.1, "floorArea": "88 m2", "keyFeatures": ["No garage", "in need of modernisation"],
"summary": "This is a long enough description of the cottage, which goes on until it has more than eighty characters in it."}]}}</script></head><body><h1>N Mill Lane</h1> EH1 1AA <script>window.__DATA__ = {"beds": 7};</script></body></html>"""
_META = """<html><head><meta property="og:title" content="3 bedroom villa, N High Street"><meta property="og:image" content="b.jpg"><meta property="place:location:latitude" content="55.95"><meta property="place:location:longitude" content="-3.2">
<meta name="description" content="Sold as seen. EPC: D"></head><body><h1>N High Street, EH2 2BB</h1><p>Fixed price £COMMAS, 2 bathrooms, 95 sq m, EPC Rating: D</p></body></html>"""
_PLAIN = """<html><body><div data-lat="55.91" data-lng="-3.3"></div><h1>Rose Cottage</h1><nav>4 bathrooms</nav><p>Two bedroom semi-detached bungalow at EH3 3CC, offers around £COMMAS. Closing date 5 March</p></body></html>"""
_PAGES = (_LINKED, _STATE, _META, _PLAIN)


def made_pages(spark: SparkSession, sf_dir: str, *texts: str) -> DataFrame:
    df = cases(spark, sf_dir, text=["{n}", *[None] * (len(texts) - 1)])
    text = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        text = F.when(F.col("id") % len(texts) == i, F.lit(t)).otherwise(text)
    fill = F.replace(F.replace(F.replace(text, F.lit("COMMAS"), F.format_number("price", 0)), F.lit('"P"'), F.concat(F.lit('"'), F.col("price").cast("string"), F.lit('"'))), F.lit("£P"), F.concat(F.lit("£"), F.col("price").cast("string")))
    fill = F.replace(fill, F.lit("N Sample"), F.concat(F.col("n").cast("string"), F.lit(" Sample")))
    for word in ("Mill", "High"):
        fill = F.replace(fill, F.lit(f"N {word}"), F.concat(F.col("n").cast("string"), F.lit(f" {word}")))
    return df.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("https://x.example/property/a/"), (36_000_000 + F.col("id")).cast("string")).alias("url"), fill.alias("html"))


_EXPECTED = {
    "title": ("VARCHAR", ["n || ' Sample Road'[1:0] || '4 bed detached house'", "'Cottage N'", "'3 bedroom villa, ' || n || ' High Street'", "''"]),
    "address": ("VARCHAR", ["n || ' Sample Road, Leith, EH4 1AB'", "n || ' Mill Lane'", "n || ' High Street, EH2 2BB'", "'Rose Cottage'"]),
    "postcode": ("VARCHAR", ["'EH4 1AB'", "'EH1 1AA'", "'EH2 2BB'", "'EH3 3CC'"]), "district": ("VARCHAR", ["'EH4'", "'EH1'", "'EH2'", "'EH3'"]),
    "lat": ("DOUBLE", ["55.96", "55.9", "55.95", "55.91"]), "lng": ("DOUBLE", ["-3.25", "-3.1", "-3.2", "-3.3"]), "price": ("INT", ["price"] * 4),
    "price_qualifier": ("VARCHAR", ["'Offers Over'", "NULL", "'Fixed Price'", "'Offers Around'"]), "bedrooms": ("INT", ["4", "3", "3", "2"]), "bathrooms": ("INT", ["2", "1", "2", "4"]), "floor_area_m2": ("INT", ["139", "88", "95", "NULL"]),
    "property_type": ("VARCHAR", ["'detached'", "'Terraced Cottage'", "'villa'", "NULL"]), "detached": ("BOOLEAN", ["true", "false", "false", "false"]), "garage": ("BOOLEAN", ["true", "false", "false", "false"]), "image": ("VARCHAR", ["'a.jpg'", "NULL", "'b.jpg'", "NULL"]),
    "band": ("VARCHAR", ["'C'", "NULL", "'D'", "NULL"]), "flags": ("VARCHAR", ["''", "'needs_work'", "'motivated'", "''"]), "closing": ("VARCHAR", ["'2026-10-10'", "NULL", "NULL", "'2027-03-05'"]), "acres": ("DOUBLE", ["0.5", "NULL", "NULL", "NULL"]),
}
_EXPECTED["title"] = ("VARCHAR", ["'4 bed detached house'", *_EXPECTED["title"][1][1:]])


@query(answers(**_EXPECTED))
def parse_listing_pages(spark, sf_dir):
    out = H.parse_listings(made_pages(spark, sf_dir, *_PAGES), today())
    return out.select(F.col("id").cast("long").alias("id"), "title", "address", "postcode", "district", "lat", "lng", "price", "price_qualifier", "bedrooms", "bathrooms", "floor_area_m2", "property_type", "detached", "garage", "image", F.col("epc.band").alias("band"), F.concat_ws(",", F.coalesce("flags", F.array().cast("array<string>"))).alias("flags"), F.col("closing_date").cast("string").alias("closing"), F.col("plot_acres").alias("acres"))


@query("SELECT page_id::VARCHAR AS id, coalesce(nullif(trim(split_part(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '|', 1)), ''), '') AS title FROM pages WHERE html IS NOT NULL AND NOT contains(html, 'og:title') AND NOT contains(html, 'ld+json') AND NOT contains(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&')")
def parse_listing_titles(spark, sf_dir):
    """The parser over the driver's own pages, where their title is plain."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    plain = ~F.col("html").contains("og:title") & ~F.col("html").contains("ld+json") & ~F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).contains("&")
    return H.parse_listings(p.where(plain).select(F.col("page_id").cast("string").alias("id"), "url", "html"), today()).select("id", "title")


_LOT = """<html><head><title>Auction Details - N Mill Street - Guide £1</title></head><body><header>Auction house</header><nav>sold as seen</nav><h1>Auction Details - N Mill Street - Guide £COMMAS</h1><p>Opening bid £COMMAS. 3 bedroom terraced house. Viewing 12 Sep 2026. The auction ends on 14/10/2026 or 20 Oct 2026.</p><a>renovation project</a></body></html>"""
_PLOT = """<html><body><h1>Building plot at N Mill Road</h1><p>Reserve price £COMMAS, about 2 hectares, repossession. Until 31 February 2027 and 3 September 2026.</p></body></html>"""
_LOCKUP = """<html><body><h1>Lock-up N High Street</h1><p>£COMMAS</p></body></html>"""


@query(answers(
    lot=("VARCHAR", ["'auc-x-' || (36000000 + id)", "'auc-x-' || (36000000 + id)", "'auc-x-' || (36000000 + id)"]), address=("VARCHAR", ["n || ' Mill Street'", "'Building plot at ' || n || ' Mill Road'", "'Lock-up ' || n || ' High Street'"]), price=("INT", ["price", "price", "price"]),
    day=("VARCHAR", ["'2026-10-14'", "'2026-09-03'", "NULL"]), basis=("VARCHAR", ["'Guide price'", "'Reserve'", "'Guide price'"]), title=("VARCHAR", ["'3 bed terraced at auction'", "'Plot / land at auction'", "'property at auction'"]), flags=("VARCHAR", ["''", "'motivated'", "''"]),
    kind=("VARCHAR", ["NULL", "'plot'", "NULL"]), not_a_home=("BOOLEAN", ["false", "false", "true"]), acres=("DOUBLE", ["NULL", "4.94", "NULL"]),
))
def parse_lot_pages(spark, sf_dir):
    made = made_pages(spark, sf_dir, _LOT, _PLOT, _LOCKUP).withColumn("url", F.replace("url", F.lit("property/a"), F.lit("lot")))
    key = F.regexp_extract("lot", r"(\d+)$", 1).cast("long") - 36_000_000
    out = H.parse_lots(made, "House", today()).withColumn("lot", F.col("id"))
    return out.select(key.alias("id"), "lot", "address", "price", F.col("auction.date").cast("string").alias("day"), F.col("auction.basis").alias("basis"), "title", F.concat_ws(",", F.coalesce("flags", F.array().cast("array<string>"))).alias("flags"), "kind", "not_a_home", F.col("plot_acres").alias("acres"))


#: Sentences that follow every text of documents, by id.
_TEXTS = ("The auction is on 12 September 2026, viewing 3rd Oct 2026", "Viewing 2 Sep 2026; bidding ends 5/9/2026", "Built 1 Jan 2020; open 31/08/2026", "no date", "31 February 2027", "Sale date: 30.11.2026", "Auction on 1 May 2026, then 2 Oct 2026")
_MONTHS = "(\\d{1,2})(?:st|nd|rd|th)?\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\\w*,?\\s+(\\d{4})"
_SLASHES = "\\b(\\d{1,2})[/.](\\d{1,2})[/.](20\\d{2})\\b"


def _found(pattern: str) -> str:
    """SQL: each match with the length of what stands before it."""
    return f"SELECT doc_id, t, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS pos FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d)"


_DATES = f"""d AS (SELECT doc_id, coalesce(text, '') || ' ' || CASE doc_id % 7 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS))} END AS t FROM documents),
f AS (SELECT doc_id, t, pos, try_cast(regexp_extract(m, '(?i){_MONTHS}', 3) || '-' || lpad(((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(regexp_extract(m, '(?i){_MONTHS}', 2))) + 2) // 3)::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(m, '(?i){_MONTHS}', 1), 2, '0') AS DATE) AS day FROM ({_found('(?i)' + _MONTHS)})
  UNION ALL SELECT doc_id, t, pos, try_cast(regexp_extract(m, '{_SLASHES}', 3) || '-' || lpad(regexp_extract(m, '{_SLASHES}', 2), 2, '0') || '-' || lpad(regexp_extract(m, '{_SLASHES}', 1), 2, '0') AS DATE) FROM ({_found(_SLASHES)})),
g AS (SELECT *, day >= DATE '2026-08-31' AS coming, regexp_matches(substr(t, greatest(pos - 80, 0)::BIGINT + 1, least(pos, 80)::BIGINT), '(?i)auction|sale date|bidding|ends?\\b') AS told FROM f WHERE day IS NOT NULL)"""


@query(f"WITH {_DATES} SELECT d.doc_id, coalesce(arg_min(day, pos) FILTER (coming AND told), arg_min(day, pos) FILTER (coming)) AS day, count(day)::INT AS dates FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id")
def auction_days(spark, sf_dir):
    which = F.col("doc_id") % len(_TEXTS)
    said = F.get(F.array(*map(F.lit, _TEXTS)), which.cast("int"))
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said).alias("t"))
    return df.select("doc_id", auction_day(F.col("t"), today()).alias("day"), F.size(dates_in(F.col("t"))).alias("dates"))


# ---------------------------------------------------------------- links and cards


def _search_pages(spark, sf_dir):
    """A search page per part: its card (twice linked), a link of the next part's listing in embedded JSON, and a foreign link."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))
    number = lambda d: (36_000_000 + F.col("k") + d).cast("string")
    html = F.concat(
        F.lit("<html><body><ul><li><div><a href=\"/property/road-eh4-1ab/"), number(0), F.lit('/?from=list#top">Photo</a><p>'), F.col("n").cast("string"), F.lit(' bedroom villa</p><a href="/property/road-eh4-1ab/'), number(0), F.lit('/">More</a></div></li><li><a href="/news/1">3 bedroom news</a></li></ul><script>{"url":"https:\\/\\/x.example\\/property\\/lane\\/'),
        number(1), F.lit('"}</script><a rel="nofollow" href="?page=9">3</a><a aria-label="Next" href="?page='), (F.col("k") + 1).cast("string"), F.lit('">&gt;&gt;</a></body></html>'),
    )
    return p.select("k", F.concat(F.lit("https://x.example/search?page="), F.lpad(F.col("k").cast("string"), 9, "0")).alias("url"), html.alias("html"))


@query("SELECT id::VARCHAR AS id, CASE WHEN own THEN 'https://x.example/property/road-eh4-1ab/' || id || CASE WHEN early THEN '/?from=list' ELSE '/' END ELSE 'https://x.example/property/lane/' || id END AS url FROM (SELECT 36000000 + k AS id, NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = k - 1) AS own, true AS early FROM (SELECT p_partkey AS k FROM part UNION SELECT p_partkey + 1 FROM part))")
def listing_links(spark, sf_dir):
    return H.listing_links(_search_pages(spark, sf_dir))


@query("SELECT (36000000 + p_partkey)::VARCHAR AS id, 'Photo ' || p_size || ' bedroom villa More' AS hint FROM part")
def listing_cards(spark, sf_dir):
    return H.card_hints(_search_pages(spark, sf_dir))


@query("SELECT p_partkey AS k, 'https://x.example/search?page=' || (p_partkey + 1) AS following FROM part")
def next_pages(spark, sf_dir):
    ship_package(spark)
    following = F.pandas_udf(lambda html, url: html.combine(url, H.next_page), "string")
    return _search_pages(spark, sf_dir).select("k", following("html", "url").alias("following"))


def _catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))
    html = F.concat(F.lit("<body><div><h3>Villa "), F.col("n").cast("string"), F.lit("</h3><span>Guide £100,000</span><a href='/lot/"), F.col("k").cast("string"), F.lit("#map'>See</a><a href=\"https://www.house.example/lot/"), F.col("k").cast("string"), F.lit("?a=1&amp;b=2\">Bid</a></div><a href='https://other.example/lot/7'>x</a><a href='/about'>y</a></body>"))
    links = F.array(F.concat(F.lit("https://www.house.example/lot/"), F.col("k").cast("string")), F.concat(F.lit("https://www.house.example/lot/"), F.col("k").cast("string"), F.lit("?a=1&b=2")))
    return p.select("k", F.concat(F.lit("https://www.house.example/catalogue?page="), F.col("k").cast("string")).alias("url"), html.alias("html"), links.alias("links"))


@query("SELECT 'auc-house-' || p_partkey AS id, 'https://www.house.example/lot/' || p_partkey || '?a=1&b=2' AS url FROM part")
def lot_links(spark, sf_dir):
    return H.lot_links(_catalogue(spark, sf_dir), r"/lot/\d+")


@query("SELECT 'https://www.house.example/lot/' || p_partkey AS url, 'Villa ' || p_size || ' Guide £100,000 See Bid' AS hint FROM part")
def lot_cards(spark, sf_dir):
    one = _catalogue(spark, sf_dir).withColumn("links", F.slice("links", 1, 1))
    return H.lot_card_hints(one)


# ---------------------------------------------------------------- values within pages, crawls


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'x' || p_size WHEN 1 THEN 'y' END AS name, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 2 THEN 1200.5 END::DOUBLE AS number, CASE p_partkey % 4 WHEN 0 THEN 'a,b,c' WHEN 1 THEN 'a' WHEN 2 THEN 'a,c' END AS ids FROM part")
def json_values(spark, sf_dir):
    """A JSON text per part, in four shapes, one of them broken."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("n"))
    shape = F.col("id") % 4
    text = F.when(shape == 0, F.concat(F.lit('{"id": "a", "NAME": "x'), "n", F.lit('", "beds": "'), "n", F.lit(' rooms", "in": [{"id": "b"}, {"deep": {"id": "c", "name": "z"}}]}')))
    text = text.when(shape == 1, '{"id": "a", "Title": "y", "beds": "none"}').when(shape == 2, '{"id": "a", "name": "", "beds": "1,200.5", "z": {"id": "c"}}').otherwise('{"id": oops')
    found = V.values(p.withColumn("text", text), "id", "text")
    name, beds, ids = V.named(found, "name", "title").select("id", F.col("value").alias("name")), V.named(found, "beds").select("id", "number"), V.in_order(found, "id").select("id", F.concat_ws(",", "values").alias("ids"))
    return p.select("id").join(name, "id", "left").join(beds, "id", "left").join(ids, "id", "left")


@query("SELECT event_id, nullif(regexp_extract(props, '\\{\"k\": (\\d+)\\}', 1), '')::DOUBLE AS k FROM events")
def event_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = V.values(e, "event_id", "props")
    return e.select("event_id").join(V.named(found, "k").select(F.col("id").alias("event_id"), F.col("number").alias("k")), "event_id", "left")


@query(literal({"kind": "VARCHAR", "value": "VARCHAR"}, [("linked", '{"a": 1}'), ("linked", '[{"b": 2}]'), ("state", '{"c": 3}'), ("state", '{"d": 4}'), ("state", '{"e": {"f": 5}}')]))
def embedded_json(spark, sf_dir):
    page = """<script type="application/ld+json">{"a": 1}</script><script type="application/LD+JSON">[{"b": 2}]</script><script type="application/ld+json">{broken</script><script type="application/json">{"c": 3}</script><script id="__NUXT_DATA__">{"d": 4}</script><script>window.__APP__ = {"e": {"f": 5}};
    var x = 1;</script>"""
    linked, state = H.embedded(H.tree(page))
    return spark.createDataFrame([("linked", json.dumps(v)) for v in linked] + [("state", json.dumps(v)) for v in state], "kind string, value string")


def _site(url: str) -> str | None:
    """Three search pages of two listings each, one of which fails; the third repeats the second."""
    if "broken" in url:
        raise OSError("refused")
    n = int(url.rpartition("page=")[2]) if "page=" in url else 1
    ids = {1: (1, 2), 2: (3, 4), 3: (3, 4)}.get(n, ())
    links = "".join(f'<a href="/property/a/3600000{i}">x</a>' for i in ids)
    return f"<html>{links}</html>"


def _links(html: str, url: str) -> dict[str, str]:
    import re

    return {m: f"https://x.example/property/a/{m}" for m in re.findall(r"/property/a/(\d+)", html)}


@query(literal({"id": "VARCHAR", "page": "VARCHAR", "complete": "BOOLEAN", "unsure": "VARCHAR"}, [(f"3600000{i}", "https://x.example/s" if i < 3 else "https://x.example/s?page=2", True, "EH1") for i in (1, 2, 3, 4)]))
def crawl_search_pages(spark, sf_dir):
    rows, complete, unsure = remote.crawl([{"url": "https://x.example/s"}, {"url": "https://x.example/broken", "districts": ["EH1"]}], _site, _links)
    return spark.createDataFrame([(i, page, complete, ",".join(sorted(unsure))) for i, _, page in rows], "id string, page string, complete boolean, unsure string")


_MAPS = {"https://x.example/sitemap.xml": ["https://x.example/sitemap-a.xml", "https://x.example/news.xml", "https://x.example/property/a/36000009"], "https://x.example/sitemap-a.xml": ["https://x.example/property/b/36000001", "https://x.example/about", "https://x.example/sitemap.xml"]}


@query(literal({"id": "VARCHAR", "url": "VARCHAR"}, [("36000009", "https://x.example/property/a/36000009"), ("36000001", "https://x.example/property/b/36000001")]))
def crawl_site_maps(spark, sf_dir):
    get = lambda u: "".join(f"<loc> {x} </loc>" for x in _MAPS.get(u, []))
    return spark.createDataFrame(list(remote.crawl_sitemaps(["https://x.example/sitemap.xml"], get, H.listing_ident)), "id string, url string")


@query("SELECT (36000000 + p_partkey)::VARCHAR AS id FROM part WHERE p_partkey % 3 <> 0")
def new_keys(spark, sf_dir):
    """Links that the state does not know yet."""
    found = H.listing_links(_search_pages(spark, sf_dir).withColumn("html", F.regexp_replace("html", "<script>.*</script>", "")))
    known = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select((36_000_000 + F.col("p_partkey")).cast("string").alias("id"))
    from placeframe.operators import state as S

    state = known.select("id", F.lit("flat").alias("excluded"), F.lit(True).alias("plot_parsed"), today().alias("fetched"), F.lit(4).alias("parser_version"))
    wanted = S.todo(found.select("id", "url", F.lit("").alias("hint"), F.col("id").alias("ord")), state, today(), cap=10_000_000)
    return wanted.select("id")


@query(literal({"step": "VARCHAR", "result": "VARCHAR"}, [("tries", "page after 3, slept 15"), ("gone", "None after 1, slept 0"), ("polite", "a,None,b; slept 1.5"), ("first", "second; first failed"), ("ranked", "SIMD 2020 zones,zones,other")]))
def fetching(spark, sf_dir):
    import urllib.error

    calls, slept = [], []

    class Answer:
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"page"

    def opener(url, timeout):
        calls.append(url)
        if "gone" in url:
            raise urllib.error.HTTPError(url, 404, "gone", {}, None)
        if len(calls) < 3:
            raise OSError("busy")
        return Answer()

    rows = [("tries", f"{remote.fetch('u', opener=opener, sleep=slept.append)} after {len(calls)}, slept {sum(slept):g}")]
    calls.clear()
    slept.clear()
    rows.append(("gone", f"{remote.fetch('gone', opener=opener, sleep=slept.append)} after {len(calls)}, slept {sum(slept):g}"))
    clock = [0.0]
    polite = remote.PoliteFetcher("https://x.example", "bot", get=lambda u: "User-agent: *\nDisallow: /private" if u.endswith("robots.txt") else u[-1], clock=lambda: clock[0], sleep=lambda s: slept.append(s))
    got = [str(polite(f"https://x.example{p}")) for p in ("/a", "/private/x", "/b")]
    rows.append(("polite", f"{','.join(got)}; slept {sum(slept):g}"))

    def fails():
        raise OSError("first failed")

    seen: list[str] = []
    rows.append(("first", f"{remote.first_that_works([fails, lambda: 'second'], seen)}; {seen[0]}"))
    ranked = remote.rank_candidates([{"title": "other"}, {"title": "zones"}, {"title": "SIMD 2020 zones"}], "zones", "simd")
    rows.append(("ranked", ",".join(r["title"] for r in ranked)))
    return spark.createDataFrame(rows, "step string, result string")


class _Layer(remote._LayerReader):
    """A paged layer of 25 features, every second of kind a, every fifth without a geometry; it speaks ring JSON only."""

    @staticmethod
    def get(url: str) -> str:
        from urllib.parse import parse_qs, urlsplit

        q = {k: v[0] for k, v in parse_qs(urlsplit(url).query).items()}
        if q["f"] == "geojson":
            return json.dumps({"error": "format"})
        if "-3.66,55.8," not in q.get("geometry", ""):
            return json.dumps({"features": []})
        rows = [{"attributes": {"i": i, "kind": "ab"[i % 2]}, "geometry": None if i % 5 == 4 else {"x": i}} for i in range(25)]
        rows = [r for r in rows if "kind = 'a'" not in q["where"] or r["attributes"]["kind"] == "a"]
        at, n = int(q["resultOffset"]), int(q["resultRecordCount"])
        return json.dumps({"features": rows[at : at + n], "exceededTransferLimit": at + n < len(rows)})


@query("SELECT mode, i::INT AS i FROM range(25) r(i), (VALUES ('pages'), ('one after another'), ('kind a')) v(mode) WHERE i % 5 <> 4 AND (mode <> 'kind a' OR i % 2 = 0)")
def paged_layer(spark, sf_dir):
    from pyspark.sql.datasource import EqualTo, GreaterThan

    options = {"url": "https://x.example/layer", "page": "10"}
    pages, single, narrow = _Layer(options | {"total": "25"}), _Layer(options), _Layer(options)
    left = list(narrow.pushFilters([EqualTo(("kind",), "a"), GreaterThan(("i",), 3)]))
    if len(pages.partitions()) != 3 or len(single.partitions()) != 1 or len(left) != 1:
        raise ValueError("a partition for each page; equalities are sent to the server")
    rows = [(mode, json.loads(properties)["i"]) for mode, reader in (("pages", pages), ("one after another", single), ("kind a", narrow)) for p in reader.partitions() for properties, _ in reader.read(p)]
    return spark.createDataFrame(rows, "mode string, i int")
