"""python -m chronoweave [--color=never|always|auto] DATE|MONTH

A day's or month's report of one device ($CHRONOWEAVE_DEVICE) from its files ($CHRONOWEAVE_FILES), of which what was read is kept
($CHRONOWEAVE_STORE); the settings ($CHRONOWEAVE_CONFIG, a TOML file) name the office's network. With $CHRONOWEAVE_DATA instead,
of a folder that has an events table.
"""

from __future__ import annotations

import os
import re
import sys
from datetime import datetime
from zoneinfo import ZoneInfo

YEAR, MONTH, DAY = "(20[0-9]{2})", "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
FORMS = [(f"{YEAR}-{MONTH}-{DAY}", "day"), (f"{YEAR}{MONTH}{DAY}", "day"), (f"{YEAR}-{MONTH}", "month"), (f"{YEAR}{MONTH}", "month")]


def parse(argument: str) -> tuple[str, str]:
    """("day", "YYYY-MM-DD") or ("month", "YYYYMM"). Days run to 31 whatever the month."""
    for form, kind in FORMS:
        m = re.fullmatch(form, argument)
        if m:
            return (kind, "-".join(m.groups())) if kind == "day" else (kind, "".join(m.groups()))
    raise ValueError(f"no date or month of this century: {argument}")


def main(args: list[str]) -> int:
    colours = [a.partition("=")[2] for a in args if a.startswith("--color=")]
    rest = [a for a in args if not a.startswith("--color=")]
    if len(rest) != 1:
        print(__doc__, file=sys.stderr)
        return 2 if rest else 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import intervals
    from .plans import device, queries, report
    from .sources import config

    kind, when = parse(rest[0])
    colour = report.use_colour(colours[-1] if colours else "auto", sys.stdout.isatty(), dict(os.environ))
    zone, own = os.environ.get("TZ", "UTC"), os.environ.get("CHRONOWEAVE_DEVICE", "0")
    spark = SparkSession.builder.appName("chronoweave").config("spark.sql.session.timeZone", zone).getOrCreate()
    if "CHRONOWEAVE_DATA" not in os.environ:
        office = config.load(os.environ["CHRONOWEAVE_CONFIG"]).office_ssid
        now = datetime.now(ZoneInfo(zone))
        print(device.text(spark, os.environ["CHRONOWEAVE_FILES"], os.environ["CHRONOWEAVE_STORE"], own, kind, when, int(now.timestamp() * 1000), office, now.date().isoformat(), colour))
        return 0
    rows, places = queries._located(spark, os.environ["CHRONOWEAVE_DATA"])
    mine = intervals.smooth(rows.where(F.col("entity") == own))
    if kind == "day":
        found = report.day_report(mine.where(F.col("day") == when))
        print(report.day_table(report.with_places(found, places.dominant, places.others), colour))
    else:
        found = report.month_report(mine.where(F.date_format("day", "yyyyMM") == when), places.dominant, F.current_date())
        print(report.month_table(report.with_places(found, places.dominant, places.others), colour))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
