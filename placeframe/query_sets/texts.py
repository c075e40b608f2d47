"""Text, number and date functions over texts made of templates; the SQL has the values that the templates imply."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeframe.config import Rules
from placeframe.functions import address as A
from placeframe.functions import numeric as N
from placeframe.functions import text as X
from placeframe.registry import answers, cases, literal, query, table, today



@query(answers(price=("INT", ["price", "price", "price", "price", "NULL", "NULL"]), qualifier=("VARCHAR", ["'Offers Over'", "'Fixed Price'", "'O/O'", "NULL", "NULL", "NULL"])))
def price_and_qualifier(spark, sf_dir):
    head = ["OFFERS OVER £{commas}", "no price here", "o/o £ {commas}", "A villa, £{price}", "£999", None]
    text = ["fixed price £99,000", "a house, fixed price £{price}", "", "offers over £1,000,000", "from £500", ""]
    df = cases(spark, sf_dir, head=head, text=text)
    price, qualifier = X.price_parts("head", "text")
    return df.select("id", price.alias("price"), qualifier.alias("qualifier"))


@query(answers(beds=("INT", ["n", "n", "3", "NULL", "8"])))
def bedrooms_in_text(spark, sf_dir):
    df = cases(spark, sf_dir, text=["{n} bedroom villa", "a {n}-bed cottage with two bedrooms", "three bedrooms and a view", "no rooms are named", "Eight-bed lodge"])
    return df.select("id", X.bedrooms("text").alias("beds"))


@query(answers(baths=("INT", ["CASE WHEN n BETWEEN 1 AND 14 THEN n ELSE 1 END", "3", "1", "2", "1"])))
def bathrooms_in_text(spark, sf_dir):
    df = cases(spark, sf_dir, text=["{n} bathrooms", "Bathrooms: 3", "bathrooms 2 x 3", "has 2 baths", "none"], page=["1 bath"] * 5)
    return df.select("id", X.bathrooms("text", "page").alias("baths"))


@query(answers(area=("INT", ["CASE WHEN n + 100 BETWEEN 25 AND 2000 THEN n + 100 END", "CAST(round_even(1200 * 0.092903, 0) AS INT)", "85", "95", "140", "NULL", "NULL"])))
def stated_floor_area(spark, sf_dir):
    df = cases(spark, sf_dir, own=["", "1,200 sq ft in all", "", "10 sq m shed, 95 sqm house", "garden room 30 sq m", "12 sq m", None], text=["", "", "about 85 m2", "", "Internal area 140 m²", "", ""])
    own = F.when(F.pmod("id", F.lit(7)) == 0, F.concat(F.lit("Floor area: "), (F.col("n") + 100).cast("string"), F.lit(" sq m"))).otherwise(F.coalesce("own", F.lit("")))
    return df.select("id", X.stated_area(own, F.coalesce("text", F.lit(""))).alias("area"))


@query(answers(code=("VARCHAR", ["'EH4 1AB'", "NULL", "'EH12 9XY'", "NULL", "'EH1 1AA'"]), district=("VARCHAR", ["'EH4'", "NULL", "'EH12'", "NULL", "'EH1'"])))
def postcode_and_district(spark, sf_dir):
    df = cases(spark, sf_dir, text=["in EH4 1AB today", "eh4 1ab", "EH12   9XY", None, "see page"], page=["EH9 9ZZ"[:0], "", "EH1 1AA", "", "at EH1 1AA"])
    code = X.postcode("text", "page")
    return df.select("id", code.alias("code"), X.district(code).alias("district"))


@query(answers(detached=("BOOLEAN", ["true", "false", "true", "false", "false", "false"])))
def detached_house(spark, sf_dir):
    kind = ["{n} bed detached house", "semi-detached house", "villa", "top flat", "villa", "semi detached"]
    words = ["", "detached", "A detached home", "a detached block", "x" * 301 + " detached", ""]
    return cases(spark, sf_dir, kind=kind, words=words).select("id", X.is_detached("kind", "words").alias("detached"))


@query(answers(garage=("BOOLEAN", ["true", "false", "false", "true", "false"]), flags=("VARCHAR", ["'motivated,needs_work'", "'needs_work'", "'motivated'", "''", "''"])))
def garage_and_flags(spark, sf_dir):
    df = cases(spark, sf_dir, text=["double garage; sold as seen and in need of modernisation", "no garage, renovation project", "without a garage, by the executors of", "garaging for {n}", "a garden"])
    return df.select("id", X.has_garage("text").alias("garage"), F.concat_ws(",", X.flags("text")).alias("flags"))


@query(answers(band=("VARCHAR", ["'C'", "'D'", "'B'", "NULL", "'E'", "NULL"])))
def certificate_band(spark, sf_dir):
    df = cases(spark, sf_dir, prop=["Band c", None, "unknown", "", "E", "Z"], text=["EPC A", "EPC Rating: D", "the EPC band B", "EPC d", "EPC F", "no band"])
    return df.select("id", X.epc_band("prop", "text").alias("band"))


@query(answers(price=("INT", ["price", "price", "price", "NULL"]), basis=("VARCHAR", ["'Opening bid'", "'Guide price'", "'Reserve'", "NULL"])))
def price_and_basis(spark, sf_dir):
    df = cases(spark, sf_dir, text=["Opening bid £{commas}", "a guide price of £ {price}", "RESERVE PRICE: £{commas}", "£{commas}"])
    price, basis = X.price_and_basis("text")
    return df.select("id", price.alias("price"), basis.alias("basis"))


@query(answers(title=("VARCHAR", ["n || ' High Street'", "'Lot ' || n", "'Plain title'", "''", "n || ' Mill Lane'"]), address=("VARCHAR", ["n || ' High Street'", "'Lot ' || n || ' | House'", "'  Plain   title '", "''", "n || ' Mill Lane'"])))
def auction_titles(spark, sf_dir):
    df = cases(spark, sf_dir, text=["Auction Details - {n} High Street - Guide £{commas}", "Property for auction in Scotland - Lot {n} | House", "  Plain   title ", None, "Future auction details - {n} Mill Lane Opening bid £1"])
    return df.select("id", X.clean_title("text").alias("title"), X.strip_address_noise("text").alias("address"))


@query(answers(school=("VARCHAR", ["'Castle Primary'", "'Old Mill Primary'", "'Canaan Lane Primary'", "'North Primary'", "'Unknown'", "'St Mary''S Rc Primary'"]), stages=("VARCHAR", ["NULL", "NULL", "'P1-P4'", "NULL", "NULL", "NULL"])))
def primary_school_name(spark, sf_dir):
    name = ["CASTLE PRIMARY SCHOOL", "X Old Mill Primary School", "Whatever", "Some", "", "ST MARY'S  RC PRIMARY SCHOOL"]
    note = [None, "", "For P1 - P4 Pupils Only - Canaan Lane Primary School", "these streets have North Primary as their catchment", None, ""]
    df = cases(spark, sf_dir, name=name, note=note)
    school, stages = X.primary_name("name", "note")
    return df.select("id", school.alias("school"), stages.alias("stages"))


@query(answers(name=("VARCHAR", ["'St Mary''S Rc'", "'Mixed McCase'", "'A/B Old'", "'12'"])))
def tidy_school_name(spark, sf_dir):
    return cases(spark, sf_dir, name=["ST MARY'S   RC", "Mixed  McCase", "A/B OLD ", "12"]).select("id", X.tidy_school("name").alias("name"))


@query(answers(label=("VARCHAR", ["'Ocean ↔ Gyle ' || n", "'Plain ' || n", "'a'"]), route=("VARCHAR", ["'Tram'", "CAST(n AS VARCHAR)", "'Long name'"])))
def route_labels(spark, sf_dir):
    df = cases(spark, sf_dir, name=["Bus {n}: Ocean => Gyle {n}", "Plain {n}", "x:  a"], short=["{n}", "{n}", ""], long=["", "Long", "Long name"], kind=["0", "3", "3"])
    return df.select("id", X.route_label("name").alias("label"), X.route_name("short", "long", F.lit("r"), "kind").alias("route"))


@query(answers(listing=("VARCHAR", ["CAST(36000000 + id AS VARCHAR)", "NULL", "NULL", "CAST(36000000 + id AS VARCHAR)"]), district=("VARCHAR", ["'EH28'", "NULL", "'KY11'", "NULL"])))
def listing_url(spark, sf_dir):
    df = cases(spark, sf_dir, head=["https://x.example/property/{n}-road-eh28-8aw/", "https://x.example/news/", "https://x.example/for-sale/a-ky11-9ab", "http://x.example/property/villa-"], tail=["id", "id", "", "id"])
    number = F.when(F.col("tail") == "id", (36_000_000 + F.col("id")).cast("string")).otherwise("")
    url = F.concat("head", number, F.when(F.pmod("id", F.lit(4)) == 3, "/?a=b#c").otherwise(""))
    return df.select("id", X.listing_id(url).alias("listing"), X.slug_district(url).alias("district"))


@query(answers(lot=("VARCHAR", ["'auc-house-' || n", "'auc-house-' || n", "'auc-' || substr(sha1('https://other.example/page/' || n), 1, 12)", "'auc-sub-' || n"])))
def lot_ids(spark, sf_dir):
    df = cases(spark, sf_dir, url=["https://www.house.example/lot/{n}", "https://house.example/view?a=1&lotId={n}", "https://other.example/page/{n}", "https://sub.house.example/lots/{n}/map"])
    return df.select("id", X.lot_id("url").alias("lot"))


@query(answers(title=("VARCHAR", ["'Houses for sale in Leith | X'", "''", "n || ' results'", "''"]), known=("BOOLEAN", ["true", "true", "false", "true"])))
def page_titles(spark, sf_dir):
    df = cases(spark, sf_dir, html=["<html><TITLE a='b'>Houses for sale\n in  Leith | X</TITLE>", "<p>none</p>", "<title>{n} results</title>", "<title> </title>"])
    return df.select("id", X.page_title("html").alias("title"), X.recognised_location("html").alias("known"))


@query(answers(plot=("BOOLEAN", ["true", "false", "true", "false", "true"])))
def plot_words(spark, sf_dir):
    df = cases(spark, sf_dir, text=["Building plot at {n} Mill Lane", "House with garden and land", "plot of land with {n} bedroom consent", "{n} bed house", "woodland"])
    beds = F.when(F.pmod("id", F.lit(5)).isin(1, 2, 3), F.col("n"))
    return df.select("id", X.is_plot("text", beds).alias("plot"))


_RULES = Rules(districts=("EH1", "EH28"))


@query(answers(why=("VARCHAR", ["'district EH99'", "'flat'", "'1 bedroom'", "NULL", "NULL", "'rental'"])))
def listing_prefilter(spark, sf_dir):
    url = ["https://x.example/property/a-eh99-1ab/36000001", "https://x.example/property/a-eh28-1ab/36000001", "https://x.example/b", "https://x.example/b", "https://x.example/property/a-eh1-1ab/36000001", ""]
    hint = ["", "a top flat, 3 beds", "1 bedroom cottage", "{n}0 bedroom house"[:0], "house with 4 bedrooms", "to let, 3 bedrooms"]
    return cases(spark, sf_dir, url=url, hint=hint).select("id", X.prefilter("url", "hint", _RULES).alias("why"))


@query(answers(why=("VARCHAR", ["'not a home or plot'", "NULL", "'flat'", "NULL", "'1 bedroom'", "'district EH99'"])))
def lot_prefilter(spark, sf_dir):
    hint = ["Lock-up at {n} Mill Lane £{commas}", None, "First floor flat, guide £{commas}", "4 bedroom villa EH1 1AA", "one bedroom cottage", "4 bedroom villa EH99 1AA"]
    return cases(spark, sf_dir, hint=hint).select("id", X.lot_prefilter("hint", _RULES).alias("why"))


@query(answers(why=("VARCHAR", ["'rental'", "'district EH99'", "NULL", "'flat'", "'bedrooms unknown'", "CASE WHEN n < 2 THEN n || ' bedroom' ELSE 'district EH99' END", "NULL"])))
def rejection_order(spark, sf_dir):
    title = ["House to let", "Building plot", "Building plot", "House", "House", "House", "Land and house"]
    kind = ["flat", "", "flat", "studio flat", "villa", "villa", "villa"]
    df = cases(spark, sf_dir, title=title, kind=kind, district=["EH99", "EH99", "EH1", "EH99", "EH1", "EH99", "EH1"])
    beds = F.when(F.pmod("id", F.lit(7)).isin(0, 5, 6), F.greatest("n", F.when(F.pmod("id", F.lit(7)) == 6, F.lit(2)).otherwise(0)))
    return df.select("id", X.rejection("title", "kind", beds, "district", rules=_RULES).alias("why"))


@query(answers(house=("VARCHAR", ["'semi'", "'detached'", "'detached'", "'terraced'", "'terraced'", "'townhouse'", "'cottage'", "'other'"])))
def house_types(spark, sf_dir):
    df = cases(spark, sf_dir, kind=["Semi-detached", "Detached villa", None, "End-terrace", "mews", "Town house", "bungalow", "villa"])
    return df.select("id", X.house_type("kind", F.pmod("id", F.lit(8)) == 2).alias("house"))


@query(answers(day=("DATE", ["'2026-10-12'", "'2027-03-05'", "'2026-08-20'", "'2026-11-03'", "NULL", "NULL", "'2025-01-02'"])))
def closing_dates(spark, sf_dir):
    text = ["Closing date: Monday 12th October at noon", "A CLOSING DATE has been set for 5 March", "closing date 20 Aug", "closing date 03/11/26", "closing date 31 February", "viewing {n} May", "Closing Date: 2nd of January, 2025"]
    return cases(spark, sf_dir, text=text).select("id", X.closing_date("text", today()).alias("day"))


@query("SELECT p_partkey AS id, CASE WHEN p_size * 30 BETWEEN 25 AND 2000 THEN p_size * 30 END::INT AS metres, CASE WHEN p_size * 100 * 0.092903 BETWEEN 25 AND 2000 THEN round_even(p_size * 100 * 0.092903, 0) END::INT AS feet, CASE WHEN p_size / 100.0 BETWEEN 0.01 AND 500 THEN round_even(p_size / 100.0, 2) END::DOUBLE AS acres, CASE WHEN p_size * 2.471 <= 500 THEN round_even(p_size * 2.471, 2) END::DOUBLE AS hectares FROM part")
def areas_and_acres(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    size = lambda c: (c).cast("string")
    return p.select("id", N.floor_area(size(F.col("n") * 30)).alias("metres"), N.floor_area(F.concat(size(F.col("n") * 100), F.lit(" about")), F.lit("sq ft")).alias("feet"), N.acres(F.col("n") / 100.0, F.lit("acres")).alias("acres"), N.acres("n", F.lit("ha")).alias("hectares"))


@query(answers(acres=("DOUBLE", ["n", "round_even(n * 2.471, 2)", "NULL", "0.25"])))
def plot_sizes(spark, sf_dir):
    return cases(spark, sf_dir, text=["about {n} acres of land", "{n} hectares", "no size", "0.25 acre"]).select("id", X.plot_acres("text").alias("acres"))


@query("SELECT o_orderkey AS id, (o_orderkey % 3000 * 1.3 / (4.8 / 3.6))::DOUBLE AS walk_s, (o_orderkey % 3000 * 1.3 / (15 / 3.6) / 60)::DOUBLE AS cycle_min, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice / (o_orderkey % 7) + 0.5) END::INT AS per_m2, floor(o_totalprice / (o_orderkey % 7 + 0.5) + 0.5)::BIGINT AS per_acre, floor((o_orderkey % 50) / 8.0 * 4047 + 0.5)::BIGINT AS m2 FROM orders")
def distances_and_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("id"), N.walk_seconds(F.pmod(k, F.lit(3000))).alias("walk_s"), N.cycle_minutes(F.pmod(k, F.lit(3000))).alias("cycle_min"), N.price_per_m2("o_totalprice", F.pmod(k, F.lit(7))).alias("per_m2"), N.price_per_acre("o_totalprice", F.pmod(k, F.lit(7)) + 0.5).alias("per_acre"), N.acres_to_m2(F.pmod(k, F.lit(50)) / 8.0).alias("m2"))


@query(answers(seconds=("INT", ["25 * 3600 + 10 * 60", "n % 24 * 3600 + 5 * 60 + 30", "NULL", "NULL", "8 * 3600"])))
def clock_times(spark, sf_dir):
    df = cases(spark, sf_dir, text=["25:10", "", "nonsense", None, " 8:00:00 "])
    text = F.when(F.pmod("id", F.lit(5)) == 1, F.concat(F.pmod("n", F.lit(24)).cast("string"), F.lit(":05:30"))).otherwise(F.col("text"))
    return df.select("id", N.clock_seconds(text).alias("seconds"))


@query("SELECT event_id AS id, floor((epoch(TIMESTAMP '2024-03-01 12:00:00') - epoch(ts::DATE::TIMESTAMP)) / 86400)::BIGINT AS days FROM events")
def days_since(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), N.days_ago(F.to_date("ts"), F.lit("2024-03-01 12:00:00").cast("timestamp")).alias("days"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + 1 WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 2 END AS day FROM orders")
def deadlines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    k = F.pmod("id", F.lit(3))
    also = F.when(F.pmod("id", F.lit(2)) == 0, F.array(F.struct(F.date_add("d", 2).alias("date")), F.struct(F.date_add("d", 9).alias("date"))))
    return o.select("id", N.deadline(F.when(k == 0, F.col("d")), F.when(k <= 1, F.date_add("d", 1)), also).alias("day"))


@query("SELECT id, took, CASE WHEN v >= 1000000 THEN '£' || CASE WHEN v % 1000000 = 0 THEN (v // 1000000)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.2f', CASE WHEN v % 125000 = 0 THEN floor(v / 10000.0 + 0.5) / 100 ELSE v / 1000000.0 END), '0'), '.') END || 'm' ELSE '£' || floor(v / 1000.0 + 0.5)::BIGINT || 'k' END AS shown, '£' || format('{:,}', v::BIGINT) AS in_full FROM (SELECT o_orderkey AS id, floor(o_totalprice)::BIGINT * (1 + o_orderkey % 9) AS v, CASE WHEN o_orderkey % 200 >= 60 THEN (o_orderkey % 200 // 60)::VARCHAR || ' h ' || (o_orderkey % 200 % 60)::VARCHAR || ' min' ELSE (o_orderkey % 200)::VARCHAR || ' min' END AS took FROM orders)")
def display_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.floor("o_totalprice") * (1 + F.pmod("o_orderkey", F.lit(9)))).alias("v"))
    return o.select("id", N.minutes_text(F.pmod("id", F.lit(200))).alias("took"), N.pounds("v").alias("shown"), N.pounds_full("v").alias("in_full"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.escape_html("text").alias("html"))


@query("SELECT district, row_number() OVER (ORDER BY left(district, 2), n, district) - 1 AS place FROM (SELECT DISTINCT 'EH' || (p_partkey % 60)::VARCHAR AS district, (p_partkey % 60) AS n FROM part WHERE p_partkey % 3 > 0 UNION SELECT 'KY' || (p_partkey % 15)::VARCHAR, p_partkey % 15 FROM part UNION SELECT 'EH', 0)")
def district_sort(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    eh = p.where("k % 3 > 0").select(F.concat(F.lit("EH"), F.pmod("k", F.lit(60)).cast("string")).alias("district"))
    ky = p.select(F.concat(F.lit("KY"), F.pmod("k", F.lit(15)).cast("string")).alias("district"))
    d = eh.unionByName(ky).unionByName(spark.createDataFrame([("EH",)], "district string")).distinct()
    return d.orderBy(*X.district_order("district"), "district").coalesce(1).select("district", F.monotonically_increasing_id().alias("place"))


@query("WITH r AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'N' || p_size WHEN p_partkey % 7 = 0 THEN 'X' || p_size || 'B' ELSE p_size || ['', 'A', 'B'][p_partkey % 3 + 1] END AS ref, count(*) AS n FROM part GROUP BY 1) SELECT ref, n, row_number() OVER (ORDER BY NOT regexp_matches(ref, '^[0-9]'), try_cast(regexp_extract(ref, '^[0-9]+') AS INT), ref)::INT AS place FROM r")
def route_sort(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    ref = F.when(k % 5 == 0, F.concat(F.lit("N"), n)).when(k % 7 == 0, F.concat(F.lit("X"), n, F.lit("B"))).otherwise(F.concat(n, F.get(F.array(F.lit(""), F.lit("A"), F.lit("B")), (k % 3).cast("int"))))
    counted = table(spark, sf_dir, "part").groupBy(ref.alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(X.route_order("ref"))))  # some two hundred labels


@query(answers(numbers=("VARCHAR", ["'70'", "'70,70a'", "'plot12'", "''", "'12'", "'5'"]), words=("VARCHAR", ["'avenue,kingston'", "'avenue,kingston'", "'mill,view'", "'cottage,main,rose,street'", "'high,street'", "'lane'"]), place=("VARCHAR", ["'EH16 5SW'", "'EH16 5SW'", "''", "'EH27 8AA'", "'EH1 1AA'", "''"])))
def home_keys(spark, sf_dir):
    address = ["70 Kingston Avenue, Edinburgh", "70 and 70a Kingston Avenue, EH16 5SW", "Plot 12 Mill View", "Rose Cottage, Main Street", "2/1 12 High Street, Edinburgh - Guide £1", "5 Lane of the City"]
    code = ["eh16  5sw", "EH16 5SW ", None, "EH27 8AA", "eh1 1aa", ""]
    df = cases(spark, sf_dir, address=address, code=code).withColumn("key", A.home_key("address", "code"))
    return df.select("id", F.concat_ws(",", "key.numbers").alias("numbers"), F.concat_ws(",", "key.words").alias("words"), F.col("key.postcode").alias("place"))


@query(answers(number=("VARCHAR", ["CAST(n AS VARCHAR)", "'2'", "NULL", "CAST(n AS VARCHAR)"]), words=("VARCHAR", ["'sample rd'", "'flat'", "'rose cottage'", "'high st and mews'"])))
def certificate_keys(spark, sf_dir):
    df = cases(spark, sf_dir, address=["{n} Sample Road, Edinburgh", "Flat 2, 14 X Road", "Rose Cottage", "{n} High Street & Mews"]).withColumn("key", A.certificate_key("address"))
    return df.select("id", F.col("key.number").alias("number"), F.concat_ws(" ", "key.words").alias("words"))
