"""A listing page and a timetable that tests read."""

from placeframe.operators import transit
from placeframe.session import materialise

LISTING_PAGE = """<html><head><title>12 Sample Road | Homes</title><script type="application/ld+json">{"@type": "House", "name": "4 bed detached house",
"address": {"streetAddress": "12 Sample Road", "postalCode": "EH4 1AB"}, "geo": {"latitude": 55.96, "longitude": -3.25}, "numberOfBedrooms": 4, "floorSize": {"value": 168, "unitCode": "MTK"},
"offers": {"price": "545000"}, "description": "A detached house with double garage. Two bathrooms. EPC rating D."}</script></head>
<body><h1>12 Sample Road</h1><p>Offers over £545,000. 4 bedrooms 2 bathrooms. Closing date: 10th October at noon</p></body></html>"""


def clock(s):
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def small_network(spark):
    """Route 22 every 10 minutes from Far by Mid and Near to Centre, 5 minutes a hop; route 44 every 20 from Cross to Centre, 10 minutes."""
    raw = spark.createDataFrame([("a", "Far", 55.990, -3.300), ("b", "Mid", 55.975, -3.250), ("c", "Near", 55.960, -3.210), ("d", "Centre", 55.9525, -3.1905), ("e", "Cross", 55.9755, -3.2505)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    at = [(f"x{k}", 25_200 + 600 * k + 300 * i, s, i) for k in range(13) for i, s in enumerate("abcd")] + [(f"y{k}", 25_200 + 1200 * k + 600 * i, s, i) for k in range(7) for i, s in enumerate("ed")]
    times = spark.createDataFrame([(t, clock(s), clock(s), stop, i) for t, s, stop, i in at], "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int")
    running = spark.createDataFrame([(f"x{k}", "22") for k in range(13)] + [(f"y{k}", "44") for k in range(7)], "trip_id string, route string")
    stops = materialise(transit.stops_in_area(raw), "stops")
    hops = transit.connections(times, running, stops)
    return stops, transit.latest_departures(hops, transit.footpaths(stops), transit.to_destination(stops))
