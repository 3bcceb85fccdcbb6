"""Queries of the day machine, its fallback and reports, and of what is kept from run to run."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..__main__ import parse
from ..constants import COVERAGE_SLACK, LABELS, MIN_PERIOD, REFRESH_TTL, SOFT_CLOSE
from ..functions import text, times
from ..operators import intervals, timeline, upsert
from ..tables import shared_folder
from . import queries as q
from . import report, usecase
from . import streams as st
from .queries import DAY_OF, START_OF, query, text_day

#: The machine once more, as a recursion over a day's numbered events.
MACHINE = f"""
grid AS (SELECT DISTINCT entity, {DAY_OF.format("time_ms")} AS day, {START_OF.format(DAY_OF.format("time_ms"))} AS s FROM ev),
started AS (SELECT entity, day, s, coalesce((SELECT max_by(active, (time_ms, seq)) FROM backlight b WHERE b.entity = g.entity AND b.time_ms < s), false) AS lit,
  coalesce((SELECT max_by(kind, (time_ms, seq)) FROM screen b WHERE b.entity = g.entity AND b.time_ms < s) = 'lock', false) AS locked,
  (SELECT max_by(group_id, (time_ms, seq)) FROM wifi b JOIN net_groups n ON n.entity = b.entity AND n.subnet = b.subnet WHERE b.entity = g.entity AND b.time_ms < s) AS network,
  (SELECT max(time_ms) FROM (SELECT entity, time_ms FROM inputs UNION ALL SELECT entity, time_ms FROM focus) b WHERE b.entity = g.entity AND b.time_ms < s) AS touched FROM grid g),
five AS (SELECT entity, time_ms, 0 AS src, seq, CASE WHEN active THEN 'on' ELSE 'off' END AS kind FROM backlight UNION ALL SELECT entity, time_ms, 1, seq, kind FROM screen
  UNION ALL SELECT entity, time_ms, 2, seq, kind FROM inputs UNION ALL SELECT entity, time_ms, 3, seq, NULL FROM focus
  UNION ALL SELECT w.entity, time_ms, 4, seq, CASE WHEN w.subnet <> '' THEN coalesce(group_id, w.subnet) END FROM wifi w LEFT JOIN net_groups n ON n.entity = w.entity AND n.subnet = w.subnet),
five_days AS (SELECT entity, unnest(CASE WHEN time_ms = {START_OF.format("d")} THEN [d, d - 1] ELSE [d] END) AS day, time_ms AS t, src, seq, kind FROM (SELECT *, {DAY_OF.format("time_ms")} AS d FROM five WHERE time_ms <= {st.NOW})),
turns AS (SELECT f.*, row_number() OVER (PARTITION BY entity, day ORDER BY t, src, seq) AS n, count(*) OVER (PARTITION BY entity, day) AS total FROM five_days f SEMI JOIN grid USING (entity, day)),
machine(entity, day, n, marks, until, prev, lit, locked, network, touched) AS (
  SELECT entity, day, 0::BIGINT, CAST([] AS STRUCT(t BIGINT, label VARCHAR)[]), s, s, lit, locked, network, touched FROM started
  UNION ALL
  SELECT entity, day, n, CASE WHEN rest THEN list_append(marks, {{'t': t, 'label': 'break'}}) WHEN touch THEN m3 WHEN moved THEN list_append(m4, {{'t': t, 'label': 'break'}}) ELSE marks END,
    CASE WHEN rest OR moved OR doze OR wake THEN t ELSE until END, t, CASE WHEN src = 0 THEN kind = 'on' ELSE lit END, CASE WHEN src = 1 THEN kind = 'lock' WHEN src = 3 THEN false ELSE locked END,
    CASE WHEN src = 4 THEN kind ELSE network END, CASE WHEN touch THEN t ELSE touched END
  FROM (SELECT *, CASE WHEN NOT wake THEN m1 WHEN len(m2) > 0 AND (m2[-1].label = 'active' OR t - m2[-1].t < {MIN_PERIOD}) THEN list_append(m2[1 : len(m2) - 1], {{'t': m2[-1].t, 'label': 'active'}}) ELSE list_append(m2, {{'t': t, 'label': 'active'}}) END AS m3,
      CASE WHEN c = 0 THEN marks WHEN marks[-1].t < prev AND prev < t THEN list_append(CASE WHEN prev - marks[-1].t < {MIN_PERIOD} AND c > 1 THEN marks[1 : c - 1] ELSE marks END, {{'t': prev, 'label': 'transit'}})
        WHEN c > 1 AND marks[-1].t - marks[-2].t < {MIN_PERIOD} THEN list_append(marks[1 : c - 2], {{'t': marks[-2].t, 'label': 'transit'}}) ELSE list_append(marks[1 : c - 1], {{'t': marks[-1].t, 'label': 'transit'}}) END AS m4
    FROM (SELECT *, m1[1 : greatest(1, list_max(list_filter(range(1, len(m1) + 1), lambda j: m1[j].label = 'active' OR t - m1[j].t >= {MIN_PERIOD})))] AS m2, touch AND (src = 3 OR lit AND NOT locked) AND (len(m1) = 0 OR m1[-1].label <> 'active') AS wake
      FROM (SELECT *, CASE WHEN doze THEN list_append(marks, {{'t': touched, 'label': 'break'}}) ELSE marks END AS m1
        FROM (SELECT f.*, o.t, o.src, o.kind, o.n AS next_n, len(f.marks) AS c, src = 0 AND o.kind = 'off' OR src = 1 AND o.kind = 'lock' AS rest, src IN (2, 3) AS touch,
            src IN (2, 3) AND len(f.marks) > 0 AND coalesce(f.marks[-1].label = 'active' AND o.t - f.touched >= {SOFT_CLOSE}, false) AS doze, src = 4 AND coalesce(o.kind <> f.network, false) AS moved
          FROM (SELECT entity, day, n + 1 AS n, marks, until, prev, lit, locked, network, touched FROM machine) f JOIN turns o ON o.entity = f.entity AND o.day = f.day AND o.n = f.n))))),
ended AS (SELECT *, coalesce(list_max(list_filter(range(1, len(marks) + 1), lambda j: marks[j].label <> 'break')), 0) AS k FROM machine m WHERE n = (SELECT coalesce(max(total), 0) FROM turns o WHERE o.entity = m.entity AND o.day = m.day)),
spans AS (SELECT entity, day, j, marks[j].t AS first_ms, CASE WHEN j < len(marks) THEN marks[j + 1].t WHEN marks[-1].label = 'active' THEN greatest(until, prev, marks[-1].t) ELSE until END AS last_ms, marks[j].label AS label FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM ended)),
tl_rows AS (SELECT entity, day, min(first_ms) AS first_ms, max(last_ms) AS last_ms, label FROM (SELECT *, sum(c) OVER (PARTITION BY entity, day ORDER BY j) AS i FROM (
  SELECT *, coalesce((lag(label) OVER w <> label OR lag(last_ms) OVER w < first_ms)::INT, 1) AS c FROM spans WHERE last_ms > first_ms WINDOW w AS (PARTITION BY entity, day ORDER BY j))) GROUP BY entity, day, i, label)
"""


def renamed(ctes: str, prefix: str, names: list[str]) -> str:
    """CTEs of the same text under other names."""
    return re.sub(rf"\b({'|'.join(names)})\b", lambda m: prefix + m[1], ctes)


CHAIN = ["raw_events", "marked", "stated", "opened", "splits", "numbered", "parted", "session_ends", "session_rows", "long_rows", "islands", "merged", "cut", "clipped", "nexts", "alternating"]
SPARE = (
    "x_raw_events AS (SELECT * FROM raw_events UNION ALL SELECT entity, CAST(least(time_ms + 3600000 - screen_on_secs * 1000, k1) AS BIGINT), 1, time_ms * 2, 'hard_open' FROM bucket_runs WHERE opens"
    " UNION ALL SELECT entity, CAST(greatest(time_ms + screen_on_secs * 1000, k2) AS BIGINT), 1, time_ms * 2 + 1, 'hard_close' FROM bucket_runs WHERE closes)"
)
NEXTS = """nexts AS (SELECT *, lead(first_ms) OVER (PARTITION BY entity, day ORDER BY first_ms, last_ms) AS nx FROM clipped),
alternating AS (SELECT entity, day, first_ms, last_ms, 'active' AS label FROM clipped UNION ALL SELECT entity, day, last_ms, nx, 'break' FROM nexts WHERE nx > last_ms)"""


def spare_ctes() -> tuple[str, ...]:
    rest = q.SESSION_CTES.strip()
    rest = rest[rest.index("marked AS") :]
    return (SPARE, *(renamed(x.strip(), "x_", CHAIN) for x in (rest, q.MERGED_CTES, q.CLIPPED_CTES, NEXTS)))


q.CTES.extend(x.strip() for x in (MACHINE, *spare_ctes()))
ROWS = "SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, last_ms, label FROM "
query("timeline", ROWS + "tl_rows")(q.q_timeline)


@query("fallback_rows", ROWS + "x_alternating")
def q_spare(spark, d):
    """The chain that serves days without backlight, over all days: of inputs only keys count."""
    return text_day(q._spare(spark, st.parsed(spark, d)))


WITH_SPARE = """used AS (SELECT DISTINCT entity, day FROM x_alternating a WHERE NOT EXISTS (SELECT 1 FROM tl_rows t WHERE t.entity = a.entity AND t.day = a.day AND label = 'active')
  AND NOT EXISTS (SELECT 1 FROM backlight b WHERE b.entity = a.entity AND CAST(make_timestamp((b.time_ms - 21600000) * 1000) AS DATE) = a.day)),
fb_rows AS (SELECT * FROM tl_rows t ANTI JOIN used USING (entity, day) UNION ALL SELECT entity, day, first_ms, last_ms, label FROM x_alternating SEMI JOIN used USING (entity, day)),
tl_located AS (SELECT *, CASE WHEN label <> 'transit' THEN (SELECT min_by(p.place, (p.first_ms, p.ord)) FROM all_periods p WHERE p.entity = i.entity AND p.first_ms <= i.last_ms AND p.last_ms > i.first_ms) END AS location FROM fb_rows i)"""
SMOOTH = q.ORACLES["smoothed"]
SMOOTH = SMOOTH[SMOOTH.index("relabelled AS") : SMOOTH.index("\nSELECT entity, CAST(day AS VARCHAR) AS day, f.a")]
SMOOTH = renamed(SMOOTH, "t_", ["relabelled", "label_islands", "smooth_rows"]).replace("FROM labelled)", "FROM tl_located)")
q.CTES.extend((WITH_SPARE, SMOOTH, "tl_smooth AS (SELECT entity, day, f.a AS first_ms, f.b AS last_ms, label, f.loc AS location FROM t_smooth_rows)"))
query("timeline_with_fallback", ROWS + "fb_rows")(q.q_fallback)
CLOCK = "lpad(CAST(({0} - epoch_ms(day::TIMESTAMP)) // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({0} - epoch_ms(day::TIMESTAMP)) // 60000 % 60 AS VARCHAR), 2, '0')"
MINUTES = "CAST(floor(({} + 30000) / 60000.0) AS BIGINT)"
LENGTH = f"lpad(CAST({MINUTES} // 60 AS VARCHAR), 2, '0') || 'h' || lpad(CAST({MINUTES} % 60 AS VARCHAR), 2, '0')"
q.CTES.append(
    """tl_day AS (SELECT entity, day, first_ms, last_ms, label, location, CAST(sum(CASE WHEN label = 'active' THEN last_ms - first_ms ELSE 0 END) OVER (PARTITION BY entity, day) AS BIGINT) AS total_ms
FROM (SELECT *, min(CASE WHEN label = 'active' THEN first_ms END) OVER (PARTITION BY entity, day) AS lo, max(CASE WHEN label = 'active' THEN first_ms END) OVER (PARTITION BY entity, day) AS hi FROM tl_smooth WHERE last_ms > first_ms) WHERE first_ms BETWEEN lo AND hi)"""
)
query(
    "timeline_day_report",
    f"""SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, last_ms, label, location, total_ms, {CLOCK.format("first_ms")} AS from_text, {CLOCK.format("last_ms")} AS to_text,
  {LENGTH.format("last_ms - first_ms", "last_ms - first_ms")} AS length_text, strftime(day, '%a') AS weekday FROM tl_day""",
)(q.q_full_day)
query(
    "timeline_month_report",
    """SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, last_ms, total_ms, coalesce((SELECT string_agg(location, ',' ORDER BY location IS DISTINCT FROM (SELECT dominant_id FROM dominant x WHERE x.entity = m.entity), location)
    FROM (SELECT DISTINCT location FROM tl_smooth i WHERE i.entity = m.entity AND i.day = m.day AND label = 'active' AND location IS NOT NULL)), '') AS locations,
  CAST((SELECT count(*) FROM tl_smooth i WHERE i.entity = m.entity AND i.day = m.day AND label <> 'active' AND i.first_ms >= m.first_ms AND i.last_ms <= m.last_ms) AS INT) AS n_breaks
FROM (SELECT entity, day, min(first_ms) FILTER (label = 'active') AS first_ms, max(last_ms) FILTER (label = 'active') AS last_ms, CAST(sum(last_ms - first_ms) FILTER (label = 'active') AS BIGINT) AS total_ms
  FROM tl_smooth WHERE day <= DATE '2024-01-31' GROUP BY ALL) m WHERE first_ms IS NOT NULL""",
)(q.q_full_month)


#: Weight from which signals are one place, so high that places stay apart.
APART = 250_000
PLACES = ["creach", "clustered", "rep_edges", "rep_sums", "dominant", "all_periods"]
_known = "\n".join(x if x.endswith(",") else f"{x}," for x in q.CTES)
_places = ",\n".join(_known[_known.index(f"{a} AS (" if a != "creach" else "creach(entity") : _known.index(b)].strip().rstrip(",") for a, b in (("creach", "rep_edges AS"), ("rep_edges", "all_periods AS"), ("all_periods", "bucket_ends AS")))


@query("other_places_apart", "SELECT p.entity, string_agg(DISTINCT place, ',' ORDER BY place) AS other_ids FROM a_all_periods p LEFT JOIN a_dominant d ON d.entity = p.entity WHERE starts_with(place, 'duet:') AND place IS DISTINCT FROM dominant_id GROUP BY p.entity", renamed(_places, "a_", PLACES).replace("w >= 3600", f"w >= {APART}"))
def q_apart(spark, d):
    """Places that aren't one with the dominant place."""
    return usecase.resolve_places(q.all_streams(spark, st.parsed(spark, d)), st.NOW, st.OFFICE, APART, moments=True).others.withColumn("other_ids", F.array_join("other_ids", ","))


@query("rows_of_days", "SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, last_ms, label FROM alternating WHERE (entity, day) IN (SELECT (CAST(e AS VARCHAR), DATE '2024-01-01' + CAST(n AS INT)) FROM range(4) a(e), range(0, 31, 3) b(n))")
def q_of_days(spark, d):
    """rows of the days listed."""
    days = spark.range(4).select(F.col("id").cast("string").alias("entity")).crossJoin(spark.range(0, 31, 3).select(F.expr("date_add(date'2024-01-01', int(id))").alias("day")))
    return text_day(q.sessions.with_breaks(q._clipped(spark, st.parsed(spark, d))).join(days, ["entity", "day"], "left_semi"))


@query("stream_order", "SELECT entity, t AS time_ms, src, kind, row_number() OVER (PARTITION BY entity, day ORDER BY t, src, seq) AS n, CAST(day AS VARCHAR) AS day FROM turns")
def q_order(spark, d):
    """Five streams in one order within each day, a moment at a day's start in both days."""
    d = st.parsed(spark, d)
    days = timeline.days_between([st.events(spark, d)])
    told = timeline.told(days, st.backlight(spark, d), st.screen(spark, d), st.inputs(spark, d), q._focus(spark, d), q._wifi(spark, d), st.NOW, st.LOCK_APP)
    rows = told.select("entity", "day", F.posexplode("events").alias("n", "e"))
    return text_day(rows.select("entity", F.col("e.t").alias("time_ms"), F.col("e.src_ord").alias("src"), "e.kind", (F.col("n") + 1).cast("long").alias("n"), "day"))


@query("replaced_days", "SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, last_ms, CASE WHEN day(day) % 2 = 0 THEN 'transit' ELSE label END AS label FROM alternating WHERE day(day) <> 10")
def q_replaced(spark, d):
    """K2: intervals written by day; then even days again, relabelled, and another run of a day that is written empty elsewhere."""
    path = f"{shared_folder(spark)}/interval-days-{uuid.uuid4().hex}"
    rows = q.sessions.with_breaks(q._clipped(spark, st.parsed(spark, d))).where(F.day("day") != 10)
    upsert.replace_days(rows, path)
    upsert.replace_days(rows.where(F.day("day") % 2 == 0).withColumn("label", F.lit("transit")), path)
    return text_day(spark.read.schema(rows.schema).parquet(path))


@query(
    "observations_by_run",
    "SELECT entity, ssid, subnet, count(DISTINCT time_ms // 604800000) AS observations FROM known GROUP BY ALL",
)
def q_runs(spark, d):
    """K4: a run a week; each adds one to what it has seen."""
    seen = q._ssid(spark, st.parsed(spark, d)).where("subnet <> ''").withColumn("week", F.floor(F.col("time_ms") / 604_800_000))
    weeks, kept = [r.week for r in seen.select("week").distinct().orderBy("week").collect()], None  # as many as runs
    for week in weeks:
        kept = upsert.count_run(kept, seen.where(F.col("week") == week), ["entity", "ssid", "subnet"])
    return kept if kept is not None else seen.select("entity", "ssid", "subnet", F.lit(0).cast("long").alias("observations"))


@query(
    "ranges_to_fetch",
    f"""SELECT entity, class, r.f AS first_ms, r.l AS last_ms FROM (SELECT entity, class, unnest([CASE WHEN a IS NULL THEN {{'f': need, 'l': upto}} END, CASE WHEN a IS NOT NULL AND need < a THEN {{'f': need, 'l': a}} END, CASE WHEN upto - b > {COVERAGE_SLACK} THEN {{'f': b, 'l': upto}} END]) AS r
FROM (SELECT DISTINCT entity, event_type AS class, 1704153600000 + CAST(entity AS BIGINT) * 86400000 * 3 AS need, 1706313600000 AS upto FROM ev) LEFT JOIN (SELECT entity, event_type AS class, min(time_ms) AS a, max(time_ms) AS b FROM ev WHERE time_ms BETWEEN 1704672000000 AND 1706313500000 AND event_type <> 'signup' GROUP BY ALL) USING (entity, class))
WHERE r IS NOT NULL""",
)
def q_ranges(spark, d):
    """M2: what is to be fetched before and after the range that is covered, or all of it."""
    e = st.events(spark, d).withColumnRenamed("event_type", "class")
    covered = upsert.widen(None, e.where(F.col("time_ms").between(1704672000000, 1706313500000) & (F.col("class") != "signup")), ["entity", "class"])
    wanted = e.select("entity", "class").distinct().withColumn("needed_ms", F.lit(1704153600000) + F.col("entity").cast("long") * 86_400_000 * 3)
    return upsert.ranges_to_fetch(wanted, covered, 1706313600000)


@query("sources_due", f"SELECT entity, class FROM (SELECT entity, event_type AS class, max(time_ms) FILTER (k % 5 = 0) AS imported FROM ev GROUP BY ALL) WHERE imported IS NULL OR 1706659200000 - imported > {REFRESH_TTL} * 12")
def q_due(spark, d):
    """M3: sources imported longer ago than the refresh time, here an hour less than it counts."""
    e = st.events(spark, d).withColumnRenamed("event_type", "class")
    imports = e.where("k % 5 = 0").select("entity", "class", F.col("time_ms").alias("imported_ms"))
    return upsert.due(e.select("entity", "class").distinct(), imports, 1706659200000 - REFRESH_TTL * 11)


TODAY = "DATE '2024-01-20'"
CACHE = f"""cache_days AS (SELECT *, day(day) % 3 = 0 AS provisional FROM (SELECT DISTINCT entity, day FROM grid WHERE day(day) % 4 <> 1)),
cache_rows AS (SELECT entity, day, {START_OF.format("day")} AS first_ms, {START_OF.format("day")} + 60000 AS last_ms, CASE WHEN day(day) = 7 THEN 'unknown' ELSE 'break' END AS label FROM cache_days),
fresh_rows AS (SELECT entity, day, first_ms, last_ms, label FROM alternating WHERE label = 'break' OR day(day) % 5 <> 0),
cache_used AS (SELECT entity, day FROM cache_days c WHERE NOT provisional AND day < {TODAY} AND day <> {DAY_OF.format("1705716000000")} OR provisional AND NOT EXISTS (SELECT 1 FROM fresh_rows f WHERE f.entity = c.entity AND f.day = c.day AND f.label = 'active'))"""


@query("cached_days", "SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, last_ms, label FROM (SELECT * FROM fresh_rows ANTI JOIN cache_used USING (entity, day) UNION ALL SELECT * FROM cache_rows SEMI JOIN cache_used USING (entity, day) WHERE label <> 'unknown')", CACHE)
def q_cached(spark, d):
    """M4, M5, F8: final days of the cache serve again, provisional ones where the day computed anew has no active row."""
    d = st.parsed(spark, d)
    days = timeline.days_between([st.events(spark, d)]).where(F.day("day") % 4 != 1)
    start = times.day_start(F.col("day"))
    cached = days.select("entity", "day", start.alias("first_ms"), (start + 60000).alias("last_ms"), F.when(F.day("day") == 7, "unknown").otherwise("break").alias("label"))
    fresh = q.sessions.with_breaks(q._clipped(spark, d)).where((F.col("label") == "break") | (F.day("day") % 5 != 0))
    return text_day(upsert.merge_cached(fresh, cached, days.withColumn("provisional", F.day("day") % 3 == 0), F.lit("2024-01-20").cast("date"), 1705716000000))


@query(
    "label_codes",
    "SELECT entity, CAST(day AS VARCHAR) AS day, first_ms, label, CAST(CASE label WHEN 'active' THEN 0 WHEN 'break' THEN 1 WHEN 'transit' THEN 2 END AS INT) AS code FROM (SELECT * REPLACE (CASE WHEN first_ms % 7 = 0 THEN 'asleep' ELSE label END AS label) FROM labelled) WHERE label <> 'asleep'",
)
def q_codes(spark, d):
    """F8: labels to codes and back; unknown ones go."""
    rows = q._labelled(spark, d).withColumn("label", F.when(F.col("first_ms") % 7 == 0, "asleep").otherwise(F.col("label")))
    coded = upsert.with_codes(rows)
    back = upsert.from_codes(coded.select("entity", "day", "first_ms", "code", F.col("code").alias("was")))
    return text_day(back.select("entity", "day", "first_ms", "label", F.col("was").alias("code")))


@query("renamed_places", "SELECT seq, CASE WHEN place IS NOT NULL AND NOT contains(place, ':') THEN 'duet:' || place ELSE place END AS location FROM (SELECT seq, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'subnet:10.' || k ELSE 'p' || k END AS place FROM ev)")
def q_places(spark, d):
    """M8: places of an old table get their kind; read twice, they get it once."""
    k = F.col("k").cast("string")
    old = st.events(spark, d).select("seq", F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 3 == 0, F.concat(F.lit("subnet:10."), k)).otherwise(F.concat(F.lit("p"), k)).alias("location"))
    return upsert.current_places(upsert.current_places(upsert.current_places(old, 0), 0), 1)


OTHERS = "list_filter(list_transform(range(0, CAST(k % 12 AS BIGINT)), lambda j: 'duet:q' || lpad(CAST(j AS VARCHAR), 2, '0')), lambda x: true)"
SYMBOL = "CASE WHEN place IS NULL THEN '' WHEN place = 'duet:p0' THEN '✓' WHEN len(others) = 1 THEN '*' WHEN i < 8 THEN substr('²³⁴⁵⁶⁷⁸⁹', i + 1, 1) ELSE CAST(i + 2 AS VARCHAR) END"


@query(
    "place_symbols",
    f"""SELECT seq, {SYMBOL} AS symbol FROM (SELECT seq, place, others, CAST(greatest(coalesce(list_position(others, place), 0) - 1, 0) AS INT) AS i FROM (
  SELECT seq, {OTHERS} AS others, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 = 1 THEN 'duet:p0' ELSE 'duet:q' || lpad(CAST(seq % 12 AS VARCHAR), 2, '0') END AS place FROM ev))""",
)
def q_symbols(spark, d):
    """X9."""
    name = lambda n: F.concat(F.lit("duet:q"), F.lpad(n.cast("string"), 2, "0"))
    k = (F.col("k") % 12).cast("int")
    others = F.when(k > 0, F.transform(F.sequence(F.lit(0), k - 1), name)).otherwise(F.array().cast("array<string>"))
    place = F.when(F.col("seq") % 5 == 0, None).when(F.col("seq") % 5 == 1, "duet:p0").otherwise(name(F.col("seq") % 12))
    return st.events(spark, d).select("seq", report.symbol(place, F.lit("duet:p0"), others).alias("symbol"))


@query("padded_cells", "SELECT seq, event_type || 'é' || repeat(' ', CAST(greatest(12 - strlen(event_type || 'é'), 0) AS INT)) AS ended, repeat(' ', CAST(greatest(k % 11 - strlen(event_type), 0) AS INT)) || event_type AS started FROM ev")
def q_padded(spark, d):
    """X11: widths are bytes; longer text stays."""
    cell = F.concat("event_type", F.lit("é"))
    return st.events(spark, d).select("seq", text.pad_end(cell, F.lit(12)).alias("ended"), text.pad_start(F.col("event_type"), (F.col("k") % 11).cast("int")).alias("started"))


@query(
    "day_table",
    f"""SELECT entity, CAST(day AS VARCHAR) AS day, row_number() OVER (PARTITION BY entity, day ORDER BY first_ms, last_ms) AS n,
  rpad(a, CAST(greatest(max(length(a)) OVER w, 5) AS INT), ' ') || '   ' || lpad(b, CAST(max(length(b)) OVER w AS INT), ' ') || '   ' || lpad(c, CAST(greatest(max(length(c)) OVER w, 8) AS INT), ' ') || '   ' || rpad(label, CAST(greatest(max(length(label)) OVER w, 4) AS INT), ' ') AS line
FROM (SELECT *, {CLOCK.format("first_ms")} AS a, {CLOCK.format("last_ms")} AS b, {LENGTH.format("last_ms - first_ms", "last_ms - first_ms")} AS c FROM (
  SELECT *, min(CASE WHEN label = 'active' THEN first_ms END) OVER (PARTITION BY entity, day) AS lo, max(CASE WHEN label = 'active' THEN first_ms END) OVER (PARTITION BY entity, day) AS hi FROM alternating WHERE last_ms > first_ms) WHERE first_ms BETWEEN lo AND hi)
WINDOW w AS (PARTITION BY entity, day)""",
)
def q_table(spark, d):
    """K6, X11: lines of the day tables of all devices."""
    rows = report.day_report(q.sessions.with_breaks(q._clipped(spark, st.parsed(spark, d)))).withColumn("location", F.lit(None).cast("string"))
    return text_day(report.table_lines(rows).select("entity", "day", "n", "line"))


@query(
    "legends",
    """SELECT seq, CASE WHEN k % 2 = 0 THEN '✓  Main office' ELSE '' END || CASE WHEN k % 2 = 0 AND k % 3 <> 2 THEN '|' ELSE '' END || CASE k % 3 WHEN 0 THEN '²  Other office' WHEN 1 THEN '² ³  Other office' ELSE '' END AS legend FROM ev""",
)
def q_legends(spark, d):
    """The symbols that rows use, and what they mean."""
    main = F.when(F.col("k") % 2 == 0, F.array(F.lit("duet:p0"))).otherwise(F.array().cast("array<string>"))
    more = F.when(F.col("k") % 3 == 0, F.array(F.lit("duet:q0"))).when(F.col("k") % 3 == 1, F.array(F.lit("duet:q1"), F.lit("duet:q0"))).otherwise(F.array().cast("array<string>"))
    others = F.array(F.lit("duet:q0"), F.lit("duet:q1"), F.lit("duet:q2"))
    return st.events(spark, d).select("seq", F.array_join(report.legend_lines(F.concat(main, more), F.lit("duet:p0"), others), "|").alias("legend"))


FORM = "(20[0-9]{2}-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?|20[0-9]{2}(0[1-9]|1[0-2])((0[1-9]|[12][0-9]|3[01]))?)"
ARGUMENTS = "CASE k % 6 " + " ".join(f"WHEN {k} THEN strftime(make_timestamp(time_ms * 1000), '{form}')" for k, form in enumerate(("%Y-%m-%d", "%Y%m%d", "%Y-%m", "%Y%m", "%y-%m-%d", "%Y-%d-%m"))) + " END"


@query("arguments", f"SELECT DISTINCT argument, CASE WHEN NOT regexp_full_match(argument, '{FORM}') THEN 'none' WHEN length(replace(argument, '-', '')) = 6 THEN 'month ' || replace(argument, '-', '') ELSE 'day ' || regexp_replace(replace(argument, '-', ''), '(....)(..)(..)', '\\1-\\2-\\3') END AS meaning FROM (SELECT {ARGUMENTS} AS argument FROM ev)")
def q_arguments(spark, d):
    """Dates and months in all forms, and what is none. The distinct ones reach the driver: some hundred."""
    at, k = times.instant(F.col("time_ms")), F.col("k") % 6
    form = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyyMMdd")).when(k == 2, F.date_format(at, "yyyy-MM")).when(k == 3, F.date_format(at, "yyyyMM")).when(k == 4, F.date_format(at, "yy-MM-dd")).otherwise(F.date_format(at, "yyyy-dd-MM"))

    def meaning(argument: str) -> str:
        try:
            return " ".join(parse(argument))
        except ValueError:
            return "none"

    found = [r.argument for r in st.events(spark, d).select(form.alias("argument")).distinct().collect()]
    return spark.createDataFrame([(x, meaning(x)) for x in found], "argument string, meaning string")


@query("colours", "SELECT choice, terminal, no_color, choice = 'always' OR choice = 'auto' AND terminal AND no_color IN ('', 'unset') AS coloured FROM (SELECT unnest(['never', 'always', 'auto']) AS choice), (SELECT unnest([true, false]) AS terminal), (SELECT unnest(['unset', '', '1']) AS no_color)")
def q_colours(spark, d):
    """K7."""
    rows = [(c, t, n, report.use_colour(c, t, {} if n == "unset" else {"NO_COLOR": n})) for c in ("never", "always", "auto") for t in (True, False) for n in ("unset", "", "1")]
    return spark.createDataFrame(rows, "choice string, terminal boolean, no_color string, coloured boolean")
