"""The day timeline: five streams drive a state machine per device and day, which yields active, break and transit rows.

A timeline under construction is a list of marks (start, label): each mark lasts to the next one, the last
to an end of its own. Rewriting earlier rows is then dropping or relabelling marks. The machine is a fold over a
day's sorted events, written in SQL, so days are folded where their events are and no Python worker runs; ``Day`` is
the same machine event by event, for streams. What happened before a day reaches it as initial state, so days are
independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MIN_PERIOD, SOFT_CLOSE
from ..functions.times import day_start, effective_day
from .asof import asof, keep_first
from .running import running

ACTIVE, BREAK, TRANSIT = "active", "break", "transit"
#: At one moment streams come in this order.
BACKLIGHT, SCREEN, INPUT, FOCUS, WIFI = range(5)


class Day:
    """State of one device's day."""

    def __init__(self, start: int, lit: bool, locked: bool, network: str | None, last_input: int | None):
        self.starts: list[int] = []
        self.labels: list[str] = []
        self.end = self.before = start
        self.lit, self.locked, self.network, self.last_input = lit, locked, network, last_input

    def mark(self, t: int, label: str) -> None:
        self.starts.append(t)
        self.labels.append(label)
        self.end = t

    def drop_last(self) -> None:
        del self.starts[-1], self.labels[-1]

    def wake(self, t: int) -> None:
        """Presence at t: rows of rest younger than ten minutes are taken back, but for a day's first row, which is relabelled."""
        if self.labels and self.labels[-1] == ACTIVE:
            return
        while len(self.labels) > 1 and self.labels[-1] != ACTIVE and t - self.starts[-1] < MIN_PERIOD:
            self.drop_last()
        if self.labels and (self.labels[-1] == ACTIVE or t - self.starts[-1] < MIN_PERIOD):
            self.labels[-1], self.end = ACTIVE, t
        else:
            self.mark(t, ACTIVE)

    def doze(self, t: int) -> None:
        """After thirty minutes without input, presence ended with the last one."""
        if self.labels and self.labels[-1] == ACTIVE and self.last_input is not None and t - self.last_input >= SOFT_CLOSE:
            self.mark(self.last_input, BREAK)
            self.end = t

    def move(self, t: int, network: str | None) -> None:
        """Another network is a transit since the event before; then a break begins. Loss of the network alone is none."""
        if network is not None and self.network is not None and network != self.network:
            if self.starts:
                if self.starts[-1] < self.before < t:
                    if self.before - self.starts[-1] < MIN_PERIOD and len(self.starts) > 1:
                        self.drop_last()
                    self.mark(self.before, TRANSIT)
                else:
                    self.labels[-1] = TRANSIT
                    if len(self.starts) > 1 and self.starts[-1] - self.starts[-2] < MIN_PERIOD:
                        del self.starts[-1], self.labels[-2]
            self.mark(t, BREAK)
        self.network = network

    def take(self, t: int, source: int, kind: str | None) -> None:
        if source == BACKLIGHT:
            self.lit = kind == "on"
            if not self.lit:
                self.mark(t, BREAK)
        elif source == SCREEN:
            self.locked = kind == "lock"
            if self.locked:
                self.mark(t, BREAK)
        elif source == WIFI:
            self.move(t, kind or None)
        else:
            if source == FOCUS:
                self.locked = False
            self.doze(t)
            if source == FOCUS or self.lit and not self.locked:
                self.wake(t)
            self.last_input = t
        self.before = t

    def rows(self) -> list[tuple[int, int, str]]:
        """Rows with a length; breaks at the end are left out, neighbours of one label are one."""
        starts, labels, end = self.starts, self.labels, self.end
        if labels and labels[-1] == ACTIVE:
            end = max(end, self.before, starts[-1])
        n = len(labels)
        while n and labels[n - 1] == BREAK:
            n, end = n - 1, starts[n - 1]
        out: list[tuple[int, int, str]] = []
        for first, last, label in zip(starts[:n], [*starts[1:n], end], labels, strict=False):
            if last > first:
                if out and out[-1][2] == label and first <= out[-1][1]:
                    out[-1] = (out[-1][0], max(out[-1][1], last), label)
                else:
                    out.append((first, last, label))
        return out


SCHEMA = "entity string, day date, first_ms long, last_ms long, label string"


def let(value: str, name: str, body: str) -> str:
    """SQL text: body, in which ``name`` is value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


MARKS = "array<struct<t:bigint,label:string>>"


def _mark(t: str, label: str) -> str:
    return f"array(named_struct('t', {t}, 'label', '{label}'))"


def _woken(marks: str) -> str:
    """Marks and end after presence at e.t: all rests younger than ten minutes are taken back down to the last active mark, but for the day's first mark."""
    kept = f"greatest(1, array_max(transform(m, (x, i) -> if(x.label = 'active' or e.t - x.t >= {MIN_PERIOD}, i + 1, 0))))"
    on = f"if(top.label = 'active' or e.t - top.t < {MIN_PERIOD}, concat(slice(m, 1, n - 1), {_mark('top.t', ACTIVE)}), concat(slice(m, 1, n), {_mark('e.t', ACTIVE)}))"
    back = let(kept, "n", let("element_at(m, n)", "top", on))
    return let(marks, "m", f"case when size(m) = 0 then {_mark('e.t', ACTIVE)} when element_at(m, -1).label = 'active' then m else {back} end")


def _moved() -> str:
    """Marks after another network at e.t: a transit since the event before, or in place of the last row, then a break."""
    since = f"concat(if(s.before - top.t < {MIN_PERIOD} and n > 1, slice(s.marks, 1, n - 1), s.marks), {_mark('s.before', TRANSIT)})"
    instead = f"if(n > 1 and top.t - get(s.marks, n - 2).t < {MIN_PERIOD}, concat(slice(s.marks, 1, n - 2), {_mark('get(s.marks, n - 2).t', TRANSIT)}), concat(slice(s.marks, 1, n - 1), {_mark('top.t', TRANSIT)}))"
    moved = let("size(s.marks)", "n", let("get(s.marks, n - 1)", "top", f"case when n = 0 then s.marks when top.t < s.before and s.before < e.t then {since} else {instead} end"))
    return f"concat({moved}, {_mark('e.t', BREAK)})"


def _step() -> str:
    """The state after event e in state s."""
    touched, focus = f"e.src_ord in ({INPUT}, {FOCUS})", f"e.src_ord = {FOCUS}"
    dozes = f"size(s.marks) > 0 and element_at(s.marks, -1).label = 'active' and coalesce(e.t - s.last_input >= {SOFT_CLOSE}, false)"
    dozed = f"if({dozes}, concat(s.marks, {_mark('s.last_input', BREAK)}), s.marks)"
    wakes = f"({focus} or s.lit and not s.locked)"
    rests = f"(e.src_ord = {BACKLIGHT} and e.kind = 'off' or e.src_ord = {SCREEN} and e.kind = 'lock')"
    other = f"(e.src_ord = {WIFI} and coalesce(e.kind <> s.network, false))"
    marks = f"case when {rests} then concat(s.marks, {_mark('e.t', BREAK)}) when {touched} and {wakes} then {_woken(dozed)} when {touched} then {dozed} when {other} then {_moved()} else s.marks end"
    # The end moves with each new last mark, and when a rest is taken back; presence that goes on leaves it.
    ends = f"{rests} or {other} or {touched} and ({dozes} or {wakes} and (size(s.marks) = 0 or element_at(s.marks, -1).label <> 'active'))"
    return f"""named_struct('marks', {marks}, 'until', if({ends}, e.t, s.until), 'before', e.t,
      'lit', if(e.src_ord = {BACKLIGHT}, e.kind = 'on', s.lit), 'locked', case when e.src_ord = {SCREEN} then e.kind = 'lock' when {focus} then false else s.locked end,
      'network', if(e.src_ord = {WIFI}, e.kind, s.network), 'last_input', if({touched}, e.t, s.last_input))"""


def _rows() -> str:
    """Rows of the last state s: those with a length; breaks at the end are left out, neighbours of one label are one."""
    kept = "coalesce(array_max(transform(s.marks, (x, i) -> if(x.label = 'break', 0, i + 1))), 0)"
    end = "case when n < size(s.marks) then get(s.marks, n).t when element_at(s.marks, -1).label = 'active' then greatest(s.until, s.before, element_at(s.marks, -1).t) else s.until end"
    parts = "transform(slice(s.marks, 1, n), (x, i) -> named_struct('first_ms', x.t, 'last_ms', if(i + 1 < n, get(s.marks, i + 1).t, until), 'label', x.label))"
    joins = "size(a) > 0 and element_at(a, -1).label = x.label and x.first_ms <= element_at(a, -1).last_ms"
    joined = "concat(slice(a, 1, size(a) - 1), array(named_struct('first_ms', element_at(a, -1).first_ms, 'last_ms', greatest(element_at(a, -1).last_ms, x.last_ms), 'label', x.label)))"
    rows = f"aggregate(filter({parts}, x -> x.last_ms > x.first_ms), cast(array() as array<struct<first_ms:bigint,last_ms:bigint,label:string>>), (a, x) -> if({joins}, {joined}, concat(a, array(x))))"
    return let(kept, "n", f"if(n = 0, cast(array() as array<struct<first_ms:bigint,last_ms:bigint,label:string>>), {let(end, 'until', rows)})")


def fold_days(days: DataFrame) -> DataFrame:
    """(entity, day, first_ms, last_ms, label) of rows (entity, day, start_ms, lit, locked, network, last_input, events); events (t, src_ord, seq, kind) come in their order."""
    zero = f"named_struct('marks', cast(array() as {MARKS}), 'until', start_ms, 'before', start_ms, 'lit', lit, 'locked', locked, 'network', network, 'last_input', last_input)"
    rows = f"aggregate(events, {zero}, (s, e) -> {_step()}, s -> {_rows()})"
    return days.select("entity", "day", F.expr(f"inline({rows})"))


def merge_focus(periods: DataFrame, points: DataFrame) -> DataFrame:
    """(entity, time_ms, bundle_id, seq): starts of focus periods, and points that the latest period begun by then doesn't cover.

    One row per moment: periods first, then points by source.
    """
    found = asof(points, periods, event_time="first_ms", order=("seq",), name="p")
    free = found.where(~F.coalesce(F.col("time_ms") < F.col("p.last_ms"), F.lit(False)))
    both = periods.select("entity", F.col("first_ms").alias("time_ms"), "bundle_id", F.lit(0).alias("src_ord"), "seq").unionByName(free.select("entity", "time_ms", "bundle_id", "src_ord", "seq"))
    return keep_first(both, ["entity", "time_ms"], ["src_ord", "seq"]).select("entity", "time_ms", "bundle_id", "seq")


def initial_state(days: DataFrame, backlight: DataFrame, screen: DataFrame, inputs: DataFrame, focus: DataFrame, wifi: DataFrame) -> DataFrame:
    """(entity, day, start_ms, lit, locked, network, last_input): what the last events before each day's 06:00 left.

    ``wifi`` has (entity, time_ms, network, seq), network null where the address was lost; the last that was known counts.
    """
    none = {"day": "date", "lit": "boolean", "kind": "string", "network": "string", "input_ms": "long"}

    def rows(df: DataFrame, at: str, side: int, **given) -> DataFrame:
        return df.select("entity", F.col(at).alias("at"), F.lit(side).alias("side"), *[(F.col(given[c]) if c in given else F.lit(None).cast(t)).alias(c) for c, t in none.items()], F.col("seq").alias("seq"))

    # All five streams and the days in one order: at one moment a day's start comes first, so only earlier events count.
    every = rows(days.select("entity", "day", day_start(F.col("day")).alias("start_ms"), F.lit(0).cast("long").alias("seq")), "start_ms", 0, day="day")
    last = inputs.select("entity", "time_ms", "seq").unionByName(focus.select("entity", "time_ms", "seq"))
    for df, given in ((backlight, {"lit": "active"}), (screen, {"kind": "kind"}), (wifi.where("network is not null"), {"network": "network"}), (last, {"input_ms": "time_ms"})):
        every = every.unionByName(rows(df, "time_ms", 1, **given))
    found = running(every, time="at", order=("side", "seq"), lasts={f"last_{c}": F.col(c) for c in none if c != "day"}).where("day is not null")
    known = found.select("entity", "day", F.col("at").alias("start_ms"), *[F.col(f"last_{c}").alias(c) for c in none if c != "day"])
    return known.select("entity", "day", "start_ms", F.coalesce("lit", F.lit(False)).alias("lit"), F.coalesce(F.col("kind") == "lock", F.lit(False)).alias("locked"), "network", F.nullif(F.col("input_ms"), F.lit(0)).alias("last_input"))


def with_network(wifi: DataFrame, groups: DataFrame) -> DataFrame:
    """Wifi events with ``network``: the group of the subnet, the subnet itself in no group, null for none."""
    joined = wifi.join(groups.select("entity", "subnet", "group_id"), ["entity", "subnet"], "left")
    return joined.select("entity", "time_ms", F.when(F.col("subnet") != "", F.coalesce("group_id", "subnet")).alias("network"), "seq")


def told(days: DataFrame, backlight: DataFrame, screen: DataFrame, inputs: DataFrame, focus: DataFrame, wifi: DataFrame, now: int, lock_app: str) -> DataFrame:
    """(entity, day, events): what happened on each of the days up to now, in order: by time, then stream; a moment at exactly 06:00 counts in both days."""
    streams = [
        backlight.select("entity", "time_ms", F.lit(BACKLIGHT).alias("src_ord"), "seq", F.when(F.col("active"), "on").otherwise("off").alias("kind")),
        screen.select("entity", "time_ms", F.lit(SCREEN).alias("src_ord"), "seq", "kind"),
        inputs.select("entity", "time_ms", F.lit(INPUT).alias("src_ord"), "seq", "kind"),
        focus.where(F.col("bundle_id") != lock_app).select("entity", "time_ms", F.lit(FOCUS).alias("src_ord"), "seq", F.lit(None).cast("string").alias("kind")),
        wifi.select("entity", "time_ms", F.lit(WIFI).alias("src_ord"), "seq", F.col("network").alias("kind")),
    ]
    events = streams[0]
    for s in streams[1:]:
        events = events.unionByName(s)
    day = effective_day(F.col("time_ms"))
    edge = F.col("time_ms") == day_start(day)
    dealt = events.where(F.col("time_ms") <= now).withColumn("day", F.explode(F.when(edge, F.array(day, F.date_sub(day, 1))).otherwise(F.array(day))))
    dealt = dealt.join(days.select("entity", "day"), ["entity", "day"], "left_semi")
    return dealt.groupBy("entity", "day").agg(F.array_sort(F.collect_list(F.struct(F.col("time_ms").alias("t"), "src_ord", "seq", "kind"))).alias("events"))


def timeline(days: DataFrame, backlight: DataFrame, screen: DataFrame, inputs: DataFrame, focus: DataFrame, wifi: DataFrame, now: int, lock_app: str) -> DataFrame:
    """(entity, day, first_ms, last_ms, label) of the days asked for; a moment at exactly 06:00 counts in both days."""
    state = initial_state(days, backlight, screen, inputs, focus.where(F.col("bundle_id") != lock_app), wifi)
    return fold_days(told(days, backlight, screen, inputs, focus, wifi, now, lock_app).join(state, ["entity", "day"]))


def days_without(main: DataFrame, days: DataFrame, lit_days: DataFrame) -> DataFrame:
    """Days on which main has no active row and the backlight was never seen: what may need a fallback."""
    active = main.where("label = 'active'").select("entity", "day").distinct()
    return days.select("entity", "day").join(active, ["entity", "day"], "left_anti").join(lit_days, ["entity", "day"], "left_anti")


def fallback(main: DataFrame, spare: DataFrame, lit_days: DataFrame) -> DataFrame:
    """Rows of ``main``; of ``spare`` on days when main has no active row, the backlight was never seen and spare has any."""
    active = main.where("label = 'active'").select("entity", "day").distinct()
    used = spare.join(active, ["entity", "day"], "left_anti").join(lit_days, ["entity", "day"], "left_anti")
    return main.join(used.select("entity", "day").distinct(), ["entity", "day"], "left_anti").unionByName(used.select(*main.columns))


def days_between(streams: list[DataFrame]) -> DataFrame:
    """(entity, day) of every effective day that has an event."""
    out = None
    for s in streams:
        d = s.select("entity", effective_day(F.col("time_ms")).alias("day"))
        out = d if out is None else out.unionByName(d)
    return out.distinct()


def lit_days(backlight: DataFrame) -> DataFrame:
    return backlight.select("entity", effective_day(F.col("time_ms")).alias("day")).distinct()

