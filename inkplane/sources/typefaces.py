"""TrueType files as tables: characters and outlines of their faces, through table functions.

A file, or a collection of several faces, is one row (font, content); its characters
and outlines come from a lateral join, so Spark deals files to tasks and the rest of a
query sees plain rows. Damaged or missing tables give no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Fixed values: (platform, encoding) of character maps in Unicode, the best first.
UNICODE = [(3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0)]
#: Codecs of older maps, which are taken where no map is in Unicode.
LEGACY = {(3, 0): "symbol", (3, 2): "cp932", (3, 3): "gb18030", (3, 4): "big5", (3, 5): "cp949", (3, 6): "johab", (1, 0): "mac_roman", (1, 1): "shift_jis", (1, 2): "big5", (1, 3): "euc_kr", (1, 25): "gb2312"}
#: Wanted characters of a font that one row of a lateral join looks up.
SLICE = 256
#: Components of composite glyphs may nest so deep.
DEPTH = 8


def _u(data: bytes, at: int, kinds: str) -> tuple:
    return struct.unpack_from(">" + kinds, data, at)


def faces(data: bytes) -> list[dict[bytes, int]]:
    """Offsets of the tables of each face."""
    if data[:4] == b"ttcf":
        starts = _u(data, 12, f"{_u(data, 8, 'I')[0]}I")
    else:
        starts = (0,)
    out = []
    for start in starts:
        rows = [start + 12 + 16 * i for i in range(_u(data, start + 4, "H")[0])]
        out.append({data[r : r + 4]: _u(data, r + 8, "I")[0] for r in rows})
    return out


# --- character maps ----------------------------------------------------------------------


def _bytes(data: bytes, at: int) -> dict[int, int]:
    return dict(enumerate(data[at + 6 : at + 262]))


def _high_bytes(data: bytes, at: int) -> dict[int, int]:
    """Format 2: codes of one or two bytes, by tables for each first byte."""
    keys, heads, found = _u(data, at + 6, "256H"), at + 518, {}
    for high, key in enumerate(keys):
        head = heads + key  # 8 bytes each, as key is eight times the number
        first, count, delta, offset = _u(data, head, "HHhH")
        start = head + 6 + offset
        for k in range(count):
            code = high if key == 0 else high << 8 | first + k
            if key == 0 and not first <= high < first + count:
                continue
            place = high - first if key == 0 else k
            (glyph,) = _u(data, start + 2 * place, "H")
            found[code] = (glyph + delta) % 65536 if glyph else 0
            if key == 0:
                break
    return found


def _segments(data: bytes, at: int) -> dict[int, int]:
    """Format 4: ranges of 16-bit codes with a shift or a list of glyphs each."""
    count, found = _u(data, at + 6, "H")[0] // 2, {}
    ends, starts = _u(data, at + 14, f"{count}H"), _u(data, at + 16 + 2 * count, f"{count}H")
    deltas, offsets = _u(data, at + 16 + 4 * count, f"{count}H"), _u(data, at + 16 + 6 * count, f"{count}H")
    for i, (start, end, delta, offset) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
        for c in range(start, min(end, 0xFFFE) + 1):
            glyph = c
            if offset:
                (glyph,) = _u(data, at + 16 + 6 * count + 2 * i + offset + 2 * (c - start), "H")
            found[c] = (glyph + delta) % 65536 if glyph or not offset else 0
    return found


def _trimmed(data: bytes, at: int, wide: bool) -> dict[int, int]:
    """Formats 6 and 10: one range with a glyph for each code."""
    first, count = _u(data, at + 12, "II") if wide else _u(data, at + 6, "HH")
    return {first + k: g for k, g in enumerate(_u(data, at + (20 if wide else 10), f"{count}H"))}


def _groups(data: bytes, at: int, same: bool) -> dict[int, int]:
    """Formats 12 and 13: ranges of 32-bit codes with glyphs in a row, or the same one."""
    found = {}
    for g in range(_u(data, at + 12, "I")[0]):
        start, end, glyph = _u(data, at + 16 + 12 * g, "III")
        found.update((c, glyph if same else glyph + c - start) for c in range(start, min(end, 0x10FFFF) + 1))
    return found


FORMATS = {0: _bytes, 2: _high_bytes, 4: _segments, 6: lambda d, a: _trimmed(d, a, False), 10: lambda d, a: _trimmed(d, a, True), 12: lambda d, a: _groups(d, a, False), 13: lambda d, a: _groups(d, a, True)}


def _decoded(found: dict[int, int], codec: str) -> dict[int, int]:
    out = {}
    for code, glyph in found.items():
        if codec == "symbol":
            out[code & 0xFF if 0xF000 <= code <= 0xF0FF else code] = glyph
            continue
        try:
            text = code.to_bytes(1 if code < 256 else 2, "big").decode(codec)
        except UnicodeDecodeError:
            continue
        if len(text) == 1:
            out[ord(text)] = glyph
    return out


def character_map(data: bytes, tables: dict[bytes, int]) -> dict[int, int]:
    """Glyph of each code point, from the best map that the face has; glyph 0 is none."""
    if b"cmap" not in tables:
        return {}
    base, maps = tables[b"cmap"], {}
    for n in range(_u(data, base + 2, "H")[0]):
        platform, encoding, offset = _u(data, base + 4 + 8 * n, "HHI")
        if _u(data, base + offset, "H")[0] in FORMATS:
            maps.setdefault((platform, encoding), base + offset)
    for kind in [*UNICODE, *LEGACY]:
        if kind in maps:
            found = FORMATS[_u(data, maps[kind], "H")[0]](data, maps[kind])
            found = _decoded(found, LEGACY[kind]) if kind in LEGACY else found
            return {c: g for c, g in found.items() if g}
    return {}


# --- outlines ----------------------------------------------------------------------------

Point = tuple[float, float, bool]


def _glyph_at(data: bytes, tables: dict[bytes, int], glyph: int) -> tuple[int, int]:
    """Where a glyph's outline begins and ends; nothing for blanks."""
    (long,) = _u(data, tables[b"head"] + 50, "h")
    at = tables[b"loca"] + glyph * (4 if long else 2)
    a, b = _u(data, at, "II") if long else (2 * x for x in _u(data, at, "HH"))
    return tables[b"glyf"] + a, tables[b"glyf"] + b


def _simple(data: bytes, at: int, count: int) -> list[list[Point]]:
    ends = _u(data, at + 10, f"{count}H")
    n, p = ends[-1] + 1, at + 10 + 2 * count
    p += 2 + _u(data, p, "H")[0]
    flags: list[int] = []
    while len(flags) < n:
        flag = data[p]
        again = data[p + 1] if flag & 8 else 0
        flags += [flag] * (again + 1)
        p += 2 if flag & 8 else 1
    axes = []
    for short, same in ((2, 16), (4, 32)):
        value, values = 0, []
        for flag in flags[:n]:
            if flag & short:
                value += data[p] if flag & same else -data[p]
                p += 1
            elif not flag & same:
                value += _u(data, p, "h")[0]
                p += 2
            values.append(value)
        axes.append(values)
    points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags, strict=False)]
    return [points[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], [e + 1 for e in ends], strict=True)]


def contours(data: bytes, tables: dict[bytes, int], glyph: int, depth: int = 0) -> list[list[Point]]:
    """Closed curves (x, y, whether on the curve) in the font's units, y upwards."""
    at, end = _glyph_at(data, tables, glyph)
    if end <= at or depth > DEPTH:
        return []
    (count,) = _u(data, at, "h")
    if count >= 0:
        return _simple(data, at, count) if count else []
    out: list[list[Point]] = []
    p, more = at + 10, True
    while more:
        flags, part = _u(data, p, "HH")
        dx, dy = _u(data, p + 4, "hh" if flags & 1 else "bb") if flags & 2 else (0, 0)
        p += 8 if flags & 1 else 6
        n = 1 if flags & 8 else 2 if flags & 64 else 4 if flags & 128 else 0
        scale = [v / 16384 for v in _u(data, p, f"{n}h")]
        a, b, c, d = {0: (1.0, 0.0, 0.0, 1.0), 1: (*scale, 0.0, 0.0, *scale), 2: (*scale[:1], 0.0, 0.0, *scale[1:]), 4: tuple(scale)}[n]
        p, more = p + 2 * n, bool(flags & 32)
        out += [[(x * a + y * c + dx, x * b + y * d + dy, on) for x, y, on in line] for line in contours(data, tables, part, depth + 1)]
    return out


def polygon(curve: list[Point], steps: int = 6) -> list[tuple[float, float]]:
    """A closed curve as corners; each quadratic piece becomes ``steps`` straight ones."""
    full: list[Point] = []
    for i, p in enumerate(curve):
        before = curve[i - 1]
        if not p[2] and not before[2]:  # between two control points the curve passes halfway
            full.append(((p[0] + before[0]) / 2, (p[1] + before[1]) / 2, True))
        full.append(p)
    first = next((i for i, p in enumerate(full) if p[2]), None)
    if first is None:
        return []
    full, out = full[first:] + full[:first] + [full[first]], []
    for i, (x, y, on) in enumerate(full[:-1]):
        if on:
            out.append((x, y))
        else:
            (ax, ay, _), (bx, by, _) = full[i - 1], full[i + 1]
            out += [((1 - t) ** 2 * ax + 2 * t * (1 - t) * x + t * t * bx, (1 - t) ** 2 * ay + 2 * t * (1 - t) * y + t * t * by) for t in (k / steps for k in range(1, steps))]
    return out


# --- table functions ---------------------------------------------------------------------


@udtf(returnType="face int, codepoint int, glyph int")
class Characters:
    """The characters of a file's faces."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for face, tables in enumerate(faces(bytes(content)) if content else ()):
            for code, glyph in sorted(character_map(bytes(content), tables).items()):
                yield face, code, glyph


@udtf(returnType="codepoint int, units int, ascent int, advance int, contours array<array<struct<x: double, y: double>>>")
class Outlines:
    """Outlines of the wanted characters of a file's first face."""

    def eval(self, content: bytes, wanted: list) -> Iterator[tuple]:
        data = bytes(content)
        tables = faces(data)[0]
        if not {b"head", b"loca", b"glyf", b"hhea", b"hmtx"} <= tables.keys():
            return
        (units,), (ascent,), (metrics,) = _u(data, tables[b"head"] + 18, "H"), _u(data, tables[b"hhea"] + 4, "h"), _u(data, tables[b"hhea"] + 34, "H")
        known = character_map(data, tables)
        for code in wanted:
            glyph = known.get(code, 0)
            (advance,) = _u(data, tables[b"hmtx"] + 4 * min(glyph, metrics - 1), "H")
            lines = [polygon(c) for c in contours(data, tables, glyph)]
            yield code, units, ascent, advance, [[{"x": x, "y": y} for x, y in line] for line in lines if len(line) > 2]


def characters(fonts: DataFrame) -> DataFrame:
    """(font, codepoint) of (font, content), faces of a collection together."""
    return fonts.lateralJoin(Characters(F.col("content").outer())).select("font", "codepoint").distinct()


def outlines(fonts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(font, codepoint, units, ascent, advance, contours) of the fonts (font, content), for each of the characters (codepoint) that are wanted; those that a font lacks get its sign for that.

    Characters are dealt in slices, so that a font of many works on many tasks.
    """
    slices = wanted.select("codepoint").distinct().groupBy(F.expr(f"codepoint div {SLICE}").alias("slice")).agg(F.sort_array(F.collect_list("codepoint")).alias("wanted"))
    rows = slices.crossJoin(fonts.select("font", "content")).repartition("slice", "font")  # fonts are few
    return rows.lateralJoin(Outlines(F.col("content").outer(), F.col("wanted").outer())).select("font", "codepoint", "units", "ascent", "advance", "contours")
