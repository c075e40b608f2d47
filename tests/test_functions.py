import datetime as dt

from pyspark.sql import functions as F

from placeframe.functions import numeric as N
from placeframe.functions import text as X
from placeframe.functions.address import certificate_key, home_key


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_rounding_and_deciles(spark):
    assert one(spark, N.half_even(F.lit(2.5)), N.half_up(F.lit(2.5)), N.half_up(F.lit(-2.5))) == (2, 3, -2)
    got = one(spark, *[N.decile(F.lit(r)) for r in (6800, 20, 3500, 700, 3000, 0)], N.decile(F.lit("x")))
    assert got == (10, 1, 6, 2, 5, None, None)
    assert one(spark, N.clock_seconds(F.lit("25:10")), N.clock_seconds(F.lit("08:30:15")), N.clock_seconds(F.lit("late"))) == (90600, 30615, None)


def test_areas_and_plots(spark):
    assert one(spark, N.floor_area(F.lit("1,076"), F.lit("sq ft")), N.floor_area(F.lit("24.9")), N.floor_area(F.lit("2001"))) == (100, None, None)
    assert one(spark, X.plot_acres(F.lit("0.35 acres")), X.plot_acres(F.lit("plot of 0.2 ha")), X.plot_acres(F.lit("a garden"))) == (0.35, 0.49, None)


def test_display(spark):
    assert one(spark, N.pounds(F.lit(1_250_000)), N.pounds(F.lit(2_000_000)), N.pounds(F.lit(350_400)), N.minutes_text(F.lit(75)), N.minutes_text(F.lit(None)), N.pounds_full(F.lit(1234567))) == ("£1.25m", "£2m", "£350k", "1 h 15 min", "–", "£1,234,567")


def test_rejection_order(spark):
    r = lambda title, beds, district: X.rejection(F.lit(title), F.lit(""), F.lit(beds).cast("int"), F.lit(district))
    got = one(
        spark, r("3 bed house for sale", 3, "EH4"), r("2 bed flat", 2, "EH4"), r("House to let", 3, "EH4"), r("House", None, "EH4"), r("1 bed cottage", 1, "EH4"), r("4 bed villa", 4, "EH48"),
        r("Building plot", None, "EH48"), r("Building plot", None, "EH4"), r("Plot 13, The Hopetoun 4 bed detached house for sale", 4, "EH30"), r("Plot for sale with planning for a 4 bed house", 4, "G12"),
    )
    assert got == (None, "flat", "rental", "bedrooms unknown", "1 bedroom", "district EH48", "district EH48", None, None, "district G12")


def test_prefilter(spark):
    u = lambda pc: F.lit(f"https://example.org/property/2-sample-lane-{pc}/36392542")
    got = one(spark, X.prefilter(u("eh4-1ab"), F.lit("3 bed house for sale")), X.prefilter(u("eh4-1ab"), F.lit("2 bedroom flat")), X.prefilter(u("eh48-8aw"), F.lit("3 bed house")), X.prefilter(u("eh4-1ab"), F.lit("1 bed house")))
    assert got == (None, "flat", "district EH48", "1 bedroom")
    assert one(spark, X.lot_prefilter(F.lit("Lock-up at High St")), X.lot_prefilter(F.lit("three bedroom house EH48 1AA £1")), X.lot_prefilter(F.lit(""))) == ("not a home or plot", "district EH48", None)


def test_closing_dates(spark):
    day = lambda text, on: X.closing_date(F.lit(text), F.lit(on))
    got = one(spark, day("Closing date: Friday 10th October at 12 noon", "2026-10-01"), day("closing date 10 January", "2026-12-20"), day("Closing date 31/02/2026", "2026-01-01"), day("Closing date: 5.11.26", "2026-01-01"), day("no date", "2026-01-01"))
    assert got == (dt.date(2026, 10, 10), dt.date(2027, 1, 10), None, dt.date(2026, 11, 5), None)


def test_lot_texts(spark):
    assert one(spark, *X.price_and_basis(F.lit("Guide price: £145,000 plus fees"))) == (145000, "Guide price")
    a, b = (X.lot_id(F.lit(u)) for u in ("https://www.sales.example/details.asp?x=1&id=991", "https://sales.example/offer.asp?id=991"))
    assert one(spark, a, b) == ("auc-sales-991", "auc-sales-991")
    assert one(spark, X.clean_title(F.lit("Auction Details - 5 High St - Guide Price £1 | Site")))[0] == "5 High St"


def test_types_and_flags(spark):
    t = lambda kind, d=False: X.house_type(F.lit(kind), F.lit(d))
    assert one(spark, t("Semi-Detached"), t("detached villa"), t("villa", True), t("mid-terrace"), t("town house"), t("Bungalow"), t(None)) == ("semi", "detached", "detached", "terraced", "townhouse", "cottage", "other")
    assert one(spark, X.flags(F.lit("Executry sale, in need of full modernisation")))[0] == ["motivated", "needs_work"]
    assert one(spark, X.has_garage(F.lit("integral garage")), X.has_garage(F.lit("no garage")), X.is_detached(F.lit("semi-detached house"), F.lit("detached garage")), X.is_detached(F.lit("villa"), F.lit("A detached home"))) == (True, False, False, True)
    assert one(spark, X.price_parts(F.lit("Offers Over £410,000"), F.lit(""))[0], X.price_parts(F.lit(""), F.lit("fixed price £ 250,000"))[1], X.bedrooms(F.lit("x"), F.lit("three bedroom"))) == (410000, "Fixed Price", 3)


def test_schools_and_routes(spark):
    k = lambda s: X.school_key(F.lit(s))
    assert one(spark, k("St Mary's RC P.  (Edinburgh)"), k("St Mary’s (Edinburgh) RC Primary")) == ("st mary s edinburgh", "st mary s edinburgh")
    name = lambda s, n: X.primary_name(F.lit(s), F.lit(n))
    assert one(spark, *name("X Castleview Primary School", None)) == ("Castleview Primary", None)
    assert one(spark, *name("CANAAN LANE PRIMARY SCHOOL", "For P1 - P4 Pupils Only - Canaan Lane Primary School")) == ("Canaan Lane Primary", "P1-P4")
    assert one(spark, X.route_label(F.lit("City 22: Ocean Terminal => Gyle Centre")))[0] == "Ocean Terminal ↔ Gyle Centre"
    df = spark.createDataFrame([("X12",), ("10",), ("3",), ("3A",)], "ref string").orderBy(X.route_order("ref"))
    assert [r[0] for r in df.collect()] == ["3", "3A", "10", "X12"]


def test_address_keys(spark):
    key = lambda a: home_key(F.lit(a), F.lit("eh16  5sw"))
    a, b, c, d = one(spark, key("70 Kingston Avenue, Edinburgh"), key("70 and 70a Kingston Avenue"), key("2/1, 14 Main Street"), key("Rose Cottage, Main Street, Town"))
    assert (a.postcode, a.numbers, a.words) == ("EH16 5SW", ["70"], ["avenue", "kingston"])
    assert b.numbers == ["70", "70a"] and c.numbers == ["14"] and c.words == ["main", "street"]
    assert d.numbers == [] and d.words == ["cottage", "main", "rose", "street"]
    e = one(spark, certificate_key(F.lit("Flat 2 14 Sample Road, Town")))[0]
    assert e.number == "14" and e.words == ["flat", "sample", "rd"]


def test_links(spark):
    u = lambda link: X.absolute_url(F.lit("https://a.example/x/y?q=1"), F.lit(link))
    assert one(spark, u("/p#f"), u("z"), u("//b.example/q"), u("http://c.example"), u("?page=2")) == ("https://a.example/p", "https://a.example/x/z", "https://b.example/q", "http://c.example", "https://a.example/x/y?page=2")
