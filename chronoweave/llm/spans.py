"""Spans of regular expressions in code points, as SQL text of built-in functions alone.

Expressions are text, since thousands of calls from Python would take longer than small tables do. Running values
over an array are made by doubling strides, so that a text with n matches takes n log n steps; a text is cut by way
of blocks of equal length, so that a cut costs no walk from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable

SPAN = "array<struct<start:int,rank:int,`end`:int,kind:string>>"
#: Code points of a block.
BLOCK = 256


def quoted(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """body, in which ``name`` is value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(name: str, step: str) -> str:
    """For each place of the array of that name, all values up to it taken together by ``step``, a sum or maximum of x and y."""
    rounds = f"sequence(0, greatest(int(ceil(log2(greatest(size({name}), 2)))) - 1, 0))"
    return f"aggregate({rounds}, {name}, (acc, k) -> transform(acc, (x, i) -> if(i < shiftleft(1, k), x, {let('get(acc, i - shiftleft(1, k))', 'y', step)})))"


def find(text: str, pattern: str, kind: str, rank: int, ok: Callable[[str], str] | None = None) -> str:
    """Array of (start, rank, end, kind) of the matches of ``pattern``, leftmost and non-overlapping, whose text is ``ok``.

    Ends are exclusive. The lengths of the pieces between the matches and those of the matches give the places.
    """
    steps = "zip_with(hits, slice(gaps, 1, size(hits)), (h, gap) -> length(h) + length(gap))"
    all_ = f"transform(hits, (h, i) -> named_struct('start', get(ends, i) - length(h), 'rank', {rank}, 'end', get(ends, i), 'kind', '{kind}', 'hit', h))"
    spans = let(steps, "steps", let(running("steps", "x + y"), "ends", all_))
    kept = spans if ok is None else f"filter({spans}, s -> {ok('s.hit')})"
    bare = f"transform({kept}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.`end`, 'kind', s.kind))"
    return let(f"regexp_extract_all({text}, {quoted(pattern)}, 0)", "hits", let(f"split({text}, {quoted(pattern)}, -1)", "gaps", bare))


def found_if(condition: str, spans: str) -> str:
    """``spans`` where a cheap test finds that there can be any, else none."""
    return f"if(coalesce({condition}, false), {spans}, cast(array() as {SPAN}))"


def has(text: str, pattern: str) -> str:
    return f"{text} rlike {quoted(pattern)}"


def blocks(text: str) -> str:
    """The text as an array of blocks."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}+', 0)"


def cut(parts: str, start: str, end: str) -> str:
    """The code points from start to end, exclusive, of a text given as blocks; an end beyond the text's is that."""
    some = f"slice({parts}, ({start}) div {BLOCK} + 1, greatest((({end}) + {BLOCK - 1}) div {BLOCK} - ({start}) div {BLOCK}, 0))"
    return f"substring(array_join({some}, ''), int(({start}) % {BLOCK}) + 1, greatest(({end}) - ({start}), 0))"


def apart(own: str, base: str) -> str:
    """Those spans of the array named ``own`` that overlap none of the one named ``base``."""
    given = f"transform({base}, b -> named_struct('at', b.start, 'side', 1, 'reach', b.`end`, 'place', -1))"
    asked = f"transform({own}, (s, i) -> named_struct('at', s.`end`, 'side', 0, 'reach', -1, 'place', i))"
    # A base span that starts before a span's end lies before it here; it overlaps if it reaches beyond the start.
    kept = f"transform(filter(transform(edges, (e, i) -> named_struct('place', e.place, 'far', get(far, i))), e -> e.place >= 0 and e.far <= get({own}, e.place).start), e -> get({own}, e.place))"
    all_ = let(f"array_sort(concat({given}, {asked}))", "edges", let("transform(edges, e -> e.reach)", "ends", let(running("ends", "greatest(x, y)"), "far", kept)))
    return f"if(size({own}) = 0 or size({base}) = 0, {own}, {all_})"


def with_base(base: str, more: str) -> str:
    """All spans of base, and those of more that overlap none of them, by start, then kind."""
    return let(base, "base", let(more, "own", f"array_sort(concat(base, {apart('own', 'base')}))"))


def joined(spans: str) -> str:
    """kind:start:end, comma-joined, of ordered spans."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, string(s.start), string(s.`end`))), ',')"


def digest(spans: str) -> str:
    return f"sha2(cast({joined(spans)} as binary), 256)"


def count(spans: str, kind: str) -> str:
    return f"bigint(size(filter({spans}, s -> s.kind = '{kind}')))"
