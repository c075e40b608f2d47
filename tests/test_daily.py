import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from placeframe import schemas
from placeframe.plans import daily, refresh
from tests.samples import LISTING_PAGE
from placeframe.sources import sinks

DAY = F.lit("2026-09-01").cast("date")
URL = "https://example.org/property/12-sample-road-eh4-1ab/36111111"
LOT_PAGE = "<html><body><h1>5 Sample Street, EH14 1AA</h1><p>Opening Bid £210,000. Three bedroom house. The auction is on 8 October 2026.</p></body></html>"


def test_a_day(spark, tmp_path):
    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    found = spark.createDataFrame([("36111111", URL, "4 bed house", 0), ("36222222", URL.replace("36111111", "36222222"), "2 bed flat", 1)], schemas.FOUND)
    pages = spark.createDataFrame([("36111111", URL, LISTING_PAGE)], schemas.PAGE)
    homes = daily.update_listings(state, found, pages, True, None, None, DAY)
    assert [(r.id, r.price, str(r.first_seen), r.parser_version) for r in homes.collect()] == [("36111111", 545000, "2026-09-01", 4)]
    again = daily.update_listings(state, found, spark.createDataFrame([], schemas.PAGE), True, None, None, F.lit("2026-09-02").cast("date"))
    assert [(str(r.fetched), str(r.last_seen)) for r in again.collect()] == [("2026-09-01", "2026-09-02")]
    lots = daily.update_lots(str(tmp_path / "lots"), spark.createDataFrame([("x", "https://sales.example/lot/55", LOT_PAGE)], schemas.PAGE), "House", True, DAY)
    assert [(r.id, r.price) for r in lots.collect()] == [("auc-sales-55", 210000)]
    run = sinks.Run(dt.datetime(2026, 9, 1, tzinfo=dt.UTC))
    daily.run_day(run, out, again, lots.where("lat is not null"), refresh.Inputs(), DAY)
    assert not run.errors and spark.read.parquet(f"{out}/listings").count() == 1 and spark.read.parquet(f"{out}/map").first().label == "4 bed"
    assert json.loads(spark.read.text(f"{out}/meta").first()[0])["listings"] == 1
    with pytest.raises(RuntimeError):
        daily.update_listings(state, found.limit(0), pages, True, None, None, DAY)
