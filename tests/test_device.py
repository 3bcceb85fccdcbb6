"""From a device's files to the text of a day and a month, over several runs."""

import bz2
import gzip
import sqlite3
import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronoweave.constants import COCOA_EPOCH_S
from chronoweave.plans import device
from chronoweave.plans.file_queries import field
from chronoweave.sources import binary

M = 60_000
DAY = 1704434400000  # 2024-01-05T06:00Z
NEXT = DAY + 24 * 60 * M


def at(ms):
    return ms / 1000 - COCOA_EPOCH_S


def clock(ms, form="%Y-%m-%d %H:%M:%S"):
    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime(form)


def database(path, tables):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.unlink(missing_ok=True)
    db = sqlite3.connect(path)
    for create, insert, rows in tables:
        db.execute(create)
        db.executemany(insert, rows)
    db.commit()
    db.close()


def power(path, lit, front=(), hours=()):
    database(
        path,
        [
            ("CREATE TABLE PLDisplayAgent_EventPoint_Display (timestamp REAL, Block TEXT, Active INT)", "INSERT INTO PLDisplayAgent_EventPoint_Display VALUES (?, 'Backlight', ?)", [(t / 1000, on) for t, on in lit]),
            ("CREATE TABLE PLApplicationAgent_EventForward_FrontmostApp (timestamp REAL, BundleID TEXT)", "INSERT INTO PLApplicationAgent_EventForward_FrontmostApp VALUES (?, ?)", [(t / 1000, b) for t, b in front]),
            ("CREATE TABLE PLDisplayAgent_Aggregate_ScreenOn (timestamp REAL, ScreenOn REAL)", "INSERT INTO PLDisplayAgent_Aggregate_ScreenOn VALUES (?, ?)", [(t / 1000, s) for t, s in hours]),
        ],
    )


def log_lines(rows):
    said = {"kbd": "com.apple.SkyLight:KeyboardEvent x", "lock": "sendDistributedNotification: com.apple.screenIsLocked", "unlock": "sendDistributedNotification: com.apple.screenIsUnlocked"}
    return "".join(f"{clock(t)}.000+0000  Df p[1:2] {said[kind]}\n" for t, kind in rows)


def wifi_lines(rows):
    return "".join(f"{clock(t, '%a %b')} {clock(t, '%d').lstrip('0').rjust(2)} {clock(t, '%H:%M:%S')}.000  IP Address: {ip} IP subnet mask: 255.255.255.0\n" for t, ip in rows)


@pytest.fixture
def files(tmp_path):
    at_ = tmp_path / "device"
    keys = [(DAY + 3 * 60 * M + k * 5 * M, "kbd") for k in range(13)] + [(DAY + 5 * 60 * M + k * 5 * M, "kbd") for k in range(25)]
    (at_ / "log").mkdir(parents=True)
    (at_ / "log" / "a.log").write_text(log_lines(keys) + "noise\n")
    power(at_ / "power" / "CurrentPowerlog.PLSQL", [(DAY + 2 * 60 * M, 1)], [(DAY + 3 * 60 * M, None)])
    (at_ / "power" / "Archives").mkdir()
    power(tmp_path / "old.db", [(DAY - 24 * 60 * M, 1), (DAY - 20 * 60 * M, 0)])
    (at_ / "power" / "Archives" / "powerlog_2024-01-04_x.PLSQL.gz").write_bytes(gzip.compress((tmp_path / "old.db").read_bytes()))
    (at_ / "wifi").mkdir()
    (at_ / "wifi" / "wifi.log").write_text(wifi_lines([(DAY + 2 * 60 * M, "10.0.0.7")]))
    (at_ / "wifi" / "wifi.log.0.bz2").write_bytes(bz2.compress(wifi_lines([(DAY - 60 * M, "10.9.0.7")]).encode()))
    import os

    for x in (at_ / "wifi").iterdir():
        os.utime(x, (DAY / 1000, DAY / 1000))
    (at_ / "sessions").mkdir()
    record = field(2, binary.I64, struct.pack("<d", at(DAY + 60 * M))) + field(3, binary.I64, struct.pack("<d", at(DAY + 10 * 60 * M))) + field(4, binary.LEN, field(3, binary.LEN, b"office-net"))
    (at_ / "sessions" / "1").write_bytes(b"x" + binary.WIFI_MARKER + record)
    database(
        at_ / "places.db",
        [
            ("CREATE TABLE anchorOccurrence (anchorDate REAL, anchorLocation TEXT)", "INSERT INTO anchorOccurrence VALUES (?, ?)", [((DAY + 60 * M) / 1000, "desk"), ((DAY - 600 * M) / 1000, "flat")]),
            ("CREATE TABLE locations (uuid TEXT, type TEXT)", "INSERT INTO locations VALUES (?, ?)", [("desk", "work"), ("flat", "ANCHOR_LOCATION_TYPE_HOME")]),
        ],
    )
    database(at_ / "usage.db", [("CREATE TABLE ZOBJECT (Z_PK INTEGER PRIMARY KEY, ZSTREAMNAME TEXT, ZSTARTDATE REAL, ZENDDATE REAL, ZVALUESTRING TEXT)", "INSERT INTO ZOBJECT (ZSTREAMNAME, ZSTARTDATE, ZENDDATE, ZVALUESTRING) VALUES ('/app/usage', ?, ?, ?)", [(at(DAY + 3 * 60 * M), at(DAY + 3 * 60 * M + 5000), "com.apple.loginwindow")])])
    (at_ / "focus").mkdir()
    return at_


def test_from_files_to_text(spark, files, tmp_path):
    store, now = f"{tmp_path}/store", DAY + 12 * 60 * M
    day = lambda now, when="2024-01-05", today="2024-01-05": device.text(spark, str(files), store, "0", "day", when, now, "office-net", today)
    first = day(now)
    assert first.split("\n") == [
        "Fri 2024-01-05",
        "",
        "Start     End   Duration   Type     At",
        first.split("\n")[3],
        "09:00   10:00      01h00   active   ✓",
        "10:00   11:00      01h00   break    ✓",
        "11:00   13:00      02h00   active   ✓",
        first.split("\n")[3],
        "Active 03h00",
        "✓  Main office",
    ]
    kept = device.Store(spark, store, device.next_run(spark, store))
    assert kept.run == 1 and kept.table("archives").count() == 1 and kept.table("backlight").count() == 3 and kept.table("events").count() == 38
    # Within the refresh time nothing is read again, though the files have more.
    (files / "log" / "b.log").write_text(log_lines([(DAY + 7 * 60 * M + 5 * M * k, "kbd") for k in range(13)]))
    device.import_files(kept, str(files), now + 4 * M, "2024-01-05")
    assert kept.table("events").count() == 38
    later = day(now + 6 * M)
    assert "11:00   14:00      03h00   active   ✓" in later and later.split("\n")[-2] == "Active 04h00"
    assert kept.table("events").count() == 50 and kept.table("archives").count() == 1
    month = device.text(spark, str(files), store, "0", "month", "202401", now + 8 * M, "office-net", "2024-01-05").split("\n")
    assert month[0] == "January 2024" and month[4].startswith("Fri 2024-01-05   09:00   14:00") and month[-1] == "✓  Main office" and sum(x.startswith(("Thu", "Fri", "Sat")) for x in month) == 1


def test_final_days_come_from_the_cache(spark, files, tmp_path):
    store = f"{tmp_path}/store"
    run = lambda n, now: device.intervals_of(device.Store(spark, store, n), str(files), "0", ["2024-01-05"], now, "office-net", "2024-01-06")[0]
    first = sorted((r.first_ms, r.last_ms, r.label) for r in run(0, NEXT + 60 * M).collect())
    known = device.Store(spark, store, 1).by_day("days", device.DAYS).collect()
    assert [(r.entity, r.provisional) for r in known] == [("0", False)] and len(first) == 4
    # What comes later for a final day changes nothing.
    (files / "log" / "b.log").write_text(log_lines([(DAY + 4 * 60 * M + M * k, "kbd") for k in range(60)]))
    assert sorted((r.first_ms, r.last_ms, r.label) for r in run(1, NEXT + 120 * M).collect()) == first
    coded = device.Store(spark, store, 2).by_day("intervals", device.INTERVALS)
    assert {r.code for r in coded.collect()} <= {0, 1, 2} and coded.where(F.col("code") == 0).count() == 2


def test_a_forbidden_folder_is_an_error(spark, files, tmp_path, monkeypatch):
    from chronoweave.sources import sqlite

    def refuse(path):
        raise PermissionError(path)

    assert sqlite.files(f"{tmp_path}/none/a.db") == []
    monkeypatch.setattr(sqlite.os, "scandir", refuse)
    with pytest.raises(PermissionError):
        sqlite.files(f"{files}/power/none.db")
