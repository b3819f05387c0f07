"""Outlines of a TrueType font's characters: what a font draws alike, told by the font itself."""

import struct
from pathlib import Path

FOLDER = Path("/usr/share/fonts/truetype/dejavu")


class Font:
    """Reads the character map (formats 4 and 12) and the glyphs of a font file."""

    def __init__(self, path):
        self.data = Path(path).read_bytes()
        tables = [self.data[12 + 16 * i : 28 + 16 * i] for i in range(self.number(4, "H"))]
        self.at = {t[:4].decode(): struct.unpack(">I", t[8:12])[0] for t in tables}
        count = self.number(self.at["maxp"] + 4, "H") + 1
        wide = self.number(self.at["head"] + 50, "h")
        places = self.numbers(self.at["loca"], "I" if wide else "H", count)
        self.places = places if wide else [2 * p for p in places]
        self.glyph_of = {}
        for i in range(self.number(self.at["cmap"] + 2, "H")):
            table = self.at["cmap"] + self.number(self.at["cmap"] + 8 + 8 * i, "I")
            kind = self.number(table, "H")
            self.glyph_of |= self.runs(table) if kind == 12 else self.segments(table) if kind == 4 else {}

    def numbers(self, at, kind, count):
        return list(struct.unpack_from(f">{count}{kind}", self.data, at))

    def number(self, at, kind):
        return struct.unpack_from(f">{kind}", self.data, at)[0]

    def runs(self, table):
        rows = [self.numbers(table + 16 + 12 * j, "I", 3) for j in range(self.number(table + 12, "I"))]
        return {point: glyph + point - low for low, high, glyph in rows for point in range(low, high + 1)}

    def segments(self, table):
        n, out = self.number(table + 6, "H") // 2, {}
        ends, starts, shifts, jumps = (self.numbers(table + at, kind, n) for at, kind in ((14, "H"), (16 + 2 * n, "H"), (16 + 4 * n, "h"), (16 + 6 * n, "H")))
        for j, (low, high, shift, jump) in enumerate(zip(starts, ends, shifts, jumps)):
            for point in range(low, min(high, 0xFFFE) + 1):
                glyph = self.number(table + 16 + 6 * n + 2 * j + jump + 2 * (point - low), "H") if jump else point
                if glyph := (glyph + shift) & 0xFFFF if glyph or not jump else 0:
                    out[point] = glyph
        return out

    def outline(self, glyph):
        """Closed curves of (x, y, on the curve), each from its least point on."""
        at = self.at["glyf"] + self.places[glyph]
        if self.places[glyph] == self.places[glyph + 1]:
            return []
        curves = self.number(at, "h")
        return self.simple(at + 10, curves) if curves >= 0 else self.composite(at + 10)

    def simple(self, at, curves):
        ends = self.numbers(at, "H", curves)
        at += 2 * curves + 2 + self.number(at + 2 * curves, "H")
        flags = []
        while len(flags) <= ends[-1]:
            flag, at = self.data[at], at + 1
            again = 0
            if flag & 8:
                again, at = self.data[at], at + 1
            flags += [flag] * (again + 1)
        axes = []
        for short, same in ((2, 16), (4, 32)):
            value, axis = 0, []
            for flag in flags:
                if flag & short:
                    value, at = value + (self.data[at] if flag & same else -self.data[at]), at + 1
                elif not flag & same:
                    value, at = value + self.number(at, "h"), at + 2
                axis.append(value)
            axes.append(axis)
        points = list(zip(*axes, [f & 1 for f in flags]))
        return [turned(points[low + 1 : high + 1]) for low, high in zip([-1, *ends], ends)]

    def composite(self, at):
        out, more = [], True
        while more:
            flag, glyph = self.numbers(at, "H", 2)
            wide = flag & 1
            dx, dy = self.numbers(at + 4, "h" if wide else "b", 2)
            at += 8 if wide else 6
            count = 1 if flag & 8 else 2 if flag & 64 else 4 if flag & 128 else 0
            m = [v / 16384 for v in self.numbers(at, "h", count)]
            at, more = at + 2 * count, flag & 32
            xx, xy, yx, yy = {0: lambda: (1, 0, 0, 1), 1: lambda: (m[0], 0, 0, m[0]), 2: lambda: (m[0], 0, 0, m[1]), 4: lambda: m}[count]()
            out += [turned([(round(x * xx + y * yx + dx), round(x * xy + y * yy + dy), on) for x, y, on in curve]) for curve in self.outline(glyph)]
        return out

    def shape(self, char):
        """The outline moved to the left edge, or None if the font lacks the character or draws nothing."""
        curves = self.outline(self.glyph_of[ord(char)]) if ord(char) in self.glyph_of else []
        left = min((x for c in curves for x, _, _ in c), default=0)
        return tuple(sorted(tuple((x - left, y, on) for x, y, on in c) for c in curves)) or None


def turned(curve):
    first = curve.index(min(curve))
    return curve[first:] + curve[:first]
