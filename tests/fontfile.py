"""Font files made for tests: character maps of every format, outlines, collections."""

import struct


def pack(kinds, *values):
    return struct.pack(">" + kinds, *values)


def cmap_table(fmt, pairs):
    """A character map of a format, for {code: glyph}."""
    codes = sorted(pairs)
    if fmt == 0:
        return pack("HHH", 0, 262, 0) + bytes(pairs.get(c, 0) for c in range(256))
    if fmt == 2:
        singles, doubles = [c for c in codes if c < 256], [c for c in codes if c > 255]
        highs = sorted({c >> 8 for c in doubles})
        keys = [8 * (highs.index(h) + 1) if h in highs else 0 for h in range(256)]
        heads, glyphs = b"", []
        n_heads = len(highs) + 1
        for k, of in enumerate([singles, *([c for c in doubles if c >> 8 == h] for h in highs)]):
            first, last = (min(of) & 255, max(of) & 255) if of else (0, -1)
            base = 0 if k == 0 else highs[k - 1] << 8
            # from the offset's own place to the list of this table
            offset = 8 * (n_heads - k) - 6 + 2 * len(glyphs)
            heads += pack("HHhH", first, last - first + 1, 0, offset)
            glyphs += [pairs.get(base + c, 0) for c in range(first, last + 1)]
        body = pack("256H", *keys) + heads + pack(f"{len(glyphs)}H", *glyphs)
        return pack("HHH", 2, 6 + len(body), 0) + body
    if fmt == 4:
        n = len(codes) + 1
        ends, starts = [*codes, 0xFFFF], [*codes, 0xFFFF]
        deltas = [(pairs[c] - c) % 65536 if i % 2 else 0 for i, c in enumerate(codes)] + [1]
        lists = [c for i, c in enumerate(codes) if i % 2 == 0]
        offsets = [0 if i % 2 else 2 * (n - i) + 2 * lists.index(c) for i, c in enumerate(codes)] + [0]
        body = pack("HHHH", 2 * n, 0, 0, 0) + pack(f"{n}H", *ends) + pack("H", 0) + pack(f"{n}H", *starts) + pack(f"{n}H", *deltas) + pack(f"{n}H", *offsets) + pack(f"{len(lists)}H", *(pairs[c] for c in lists))
        return pack("HHH", 4, 6 + len(body), 0) + body
    first, last = codes[0], codes[-1]
    row = [pairs.get(c, 0) for c in range(first, last + 1)]
    if fmt == 6:
        return pack("HHHHH", 6, 10 + 2 * len(row), 0, first, len(row)) + pack(f"{len(row)}H", *row)
    if fmt == 10:
        return pack("HHIIII", 10, 0, 20 + 2 * len(row), 0, first, len(row)) + pack(f"{len(row)}H", *row)
    groups = b"".join(pack("III", c, c, pairs[c]) for c in codes)
    return pack("HHIII", fmt, 0, 16 + len(groups), 0, len(codes)) + groups


def cmap(*maps):
    """The table of (platform, encoding, format, pairs)."""
    head, body, at = pack("HH", 0, len(maps)), b"", 4 + 8 * len(maps)
    for platform, encoding, fmt, pairs in maps:
        head += pack("HHI", platform, encoding, at + len(body))
        body += cmap_table(fmt, pairs)
    return head + body


def outline(curves):
    """A simple glyph of closed curves [(x, y, on)]."""
    if not curves:
        return b""
    points = [p for c in curves for p in c]
    ends, n = [], -1
    for c in curves:
        n += len(c)
        ends.append(n)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    steps = lambda v: pack(f"{len(v)}h", *(b - a for a, b in zip([0, *v[:-1]], v)))
    made = pack("hhhhh", len(curves), min(xs), min(ys), max(xs), max(ys)) + pack(f"{len(ends)}H", *ends) + pack("H", 0) + bytes(int(p[2]) for p in points) + steps(xs) + steps(ys)
    return made + b"\0" * (-len(made) % 4)


def composite(parts):
    """Glyph of (number, dx, dy, scale or None)."""
    made = pack("hhhhh", -1, 0, 0, 0, 0)
    for k, (glyph, dx, dy, scale) in enumerate(parts):
        flags = 1 | 2 | (32 if k + 1 < len(parts) else 0) | (8 if scale else 0)
        made += pack("HHhh", flags, glyph, dx, dy) + (pack("h", int(scale * 16384)) if scale else b"")
    return made + b"\0" * (-len(made) % 4)


def tables(maps, glyphs=None, units=1000, ascent=880):
    out = {b"cmap": cmap(*maps)}
    if glyphs is not None:
        at = [0]
        for g in glyphs:
            at.append(at[-1] + len(g))
        out |= {
            b"head": b"\0" * 18 + pack("H", units) + b"\0" * 30 + pack("hh", 1, 0),
            b"hhea": pack("Ihh", 0, ascent, -120) + b"\0" * 26 + pack("H", 1),
            b"hmtx": pack("Hh", units, 0),
            b"loca": pack(f"{len(at)}I", *at),
            b"glyf": b"".join(glyphs),
        }
    return out


def font(maps, glyphs=None, start=0, **more):
    """A file with one face, whose offsets count from ``start`` before it."""
    made = tables(maps, glyphs, **more)
    at, head, body = start + 12 + 16 * len(made), pack("IHHHH", 0x00010000, len(made), 0, 0, 0), b""
    for tag, data in made.items():
        head += tag + pack("III", 0, at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return head + body


def collection(*faces):
    """A collection of faces, each the arguments of ``font``."""
    at, made, starts = 12 + 4 * len(faces), b"", []
    for face in faces:
        starts.append(at + len(made))
        made += font(*face, start=at + len(made))
    return b"ttcf" + pack("II", 0x00010000, len(faces)) + pack(f"{len(faces)}I", *starts) + made
