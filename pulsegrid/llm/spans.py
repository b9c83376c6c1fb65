"""Where a pattern matches, with DataFrame functions only.

``split`` gives the gaps between the matches that ``regexp_extract_all`` gives,
so running sums of both lengths are the matches' places in code points.
Patterns that could try every start of a long run use possessive repetition and
look-behind, which leaves their matches as they are and keeps the time linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are placed together, and code points of a piece.
CHUNK, PIECE = 256, 2048
SPAN = "array<struct<s:int,e:int,hit:string,part:string>>"


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """Spans (s, e, hit, part) of the leftmost non-overlapping matches in the column ``text``; ``part`` is the group."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    hits = f"regexp_extract_all({text}, '{quoted}', 0)"
    parts = f"regexp_extract_all({text}, '{quoted}', {group})"
    gaps = f"split({text}, '{quoted}', -1)"
    # running sums in two steps, so that a text with many matches is not copied for each of them
    z = f"zip_with(zip_with({gaps}, {hits}, (g, h) -> struct(char_length(g) as gap, h as hit)), {parts}, (x, p) -> struct(x.gap as gap, x.hit as hit, p as part))"
    chunks = f"transform(sequence(0, greatest(size(z) - 1, 0) div {CHUNK}), c -> filter(slice(z, c * {CHUNK} + 1, {CHUNK}), x -> x.hit is not null))"
    starts = "aggregate(chunks, array(0), (a, c) -> concat(a, array(element_at(a, -1) + aggregate(c, 0, (t, x) -> t + x.gap + char_length(x.hit)))))"
    spans = f"""flatten(zip_with(chunks, slice(starts, 1, size(chunks)), (c, first) -> aggregate(c,
          cast(struct(first as at, array() as spans) as struct<at:int,spans:{SPAN}>),
          (acc, x) -> cast(struct(acc.at + x.gap + char_length(x.hit) as at,
            concat(acc.spans, array(struct(acc.at + x.gap as s, acc.at + x.gap + char_length(x.hit) as e, x.hit as hit, x.part as part))) as spans)
            as struct<at:int,spans:{SPAN}>),
          acc -> acc.spans)))"""
    # each name is bound once, by a transform over an array of one
    bound = f"element_at(transform(array({z}), z -> element_at(transform(array({chunks}), chunks -> element_at(transform(array({starts}), starts -> {spans}), 1)), 1)), 1)"
    return F.expr(f"case when {text} is null or not ({text} rlike '{quoted}') then cast(array() as {SPAN}) else {bound} end")


def pieces(text: str, some: str) -> Column:
    """The text in pieces of PIECE code points, in one pass, if ``some`` (SQL) holds; else none. For ``around``."""
    return F.expr(f"case when {some} then regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0) else cast(array() as array<string>) end")


def around(parts: str, width: int = 48) -> str:
    """SQL for the lower-cased text near a span ``x``, of the pieces that ``parts`` holds: no walk from the text's start."""
    near = lambda at: f"concat_ws('', slice({parts}, greatest(({at}) div {PIECE}, 1), 3))"
    offset = lambda at: f"(({at}) - (greatest(({at}) div {PIECE}, 1) - 1) * {PIECE})"
    return f"lower(concat(substring({near('x.s')}, greatest({offset('x.s')} - {width}, 0) + 1, least(x.s, {width})), ' ', substring({near('x.e')}, {offset('x.e')} + 1, {width})))"


def told(kind: str, spans: str) -> str:
    """SQL for the spans as kind:start:end."""
    return f"transform({spans}, x -> concat('{kind}:', x.s, ':', x.e))"
