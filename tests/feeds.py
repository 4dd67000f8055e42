"""Small feeds for tests: a ferry of one line, with files put in place of others."""

from __future__ import annotations

import zipfile

PIERS = {"quay": (34.300, 132.40), "mill": (34.312, 132.43), "isle": (34.327, 132.45), "cape": (34.341, 132.49)}


def times(*trips: tuple[str, int, list[str]], step: int = 12) -> str:
    """stop_times of trips (id, minute of the first departure, stops)."""
    lines = ["trip_id,stop_sequence,stop_id,arrival_time,departure_time"]
    for trip, start, stops in trips:
        for i, stop in enumerate(stops):
            clock = "{:02d}:{:02d}:00".format(*divmod(start + step * i, 60))
            lines.append(f"{trip},{10 * (i + 1)},{stop},{clock},{clock}")
    return "\n".join(lines) + "\n"


BASE = {
    "agency": "agency_id,agency_name,agency_url,agency_timezone\nferry,Bay Ferry,http://ferry.example,Asia/Tokyo\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\n" + "".join(f"{k},{k.title()} Pier,{y},{x}\n" for k, (y, x) in PIERS.items()),
    "routes": "route_id,agency_id,route_short_name,route_long_name,route_type\nbay,ferry,F,Bay Crossing,4\n",
    "trips": "route_id,service_id,trip_id,trip_headsign\n" + "".join(f"bay,week,{t},Cape\n" for t in ("dawn", "noon", "dusk")),
    "stop_times": times(("dawn", 395, list(PIERS)), ("noon", 735, list(PIERS)), ("dusk", 1070, list(PIERS))),
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nweek,1,1,1,1,1,0,0,20270111,20270620\n",
}


def write(folder, name: str, encoding: str = "utf-8", nested: str = "", **files: str | None) -> str:
    """A zipped feed: the base with files replaced, added or (None) left out."""
    path = f"{folder}/{name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for n, text in (BASE | files).items():
            if text is not None:
                z.writestr(f"{nested}{n}.txt", text.encode(encoding))
    return "file://" + path
