"""Content streams of a page: glyphs, covers, and the operators that matter for text modes."""

from __future__ import annotations

import re
from functools import lru_cache

from .objects import File, Lexer, Name, Op, PdfError, Stream

#: Advance widths of Helvetica for the characters from space to tilde.
_HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
_DEPTH = 12
_SHOWS = ("Tj", "TJ", "'", '"')
#: Operands of inline images that end with a bare EI.
_INLINE_END = re.compile(rb"[\s]EI(?=[\s]|$)")


def matrix(a, b):
    """a applied first, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def box(points, m) -> tuple[float, float, float, float]:
    xs = [x * m[0] + y * m[2] + m[4] for x, y in points]
    ys = [x * m[1] + y * m[3] + m[5] for x, y in points]
    return min(xs), min(ys), max(xs), max(ys)


def brightness(color) -> float | None:
    c = color
    if len(c) == 1:
        return float(c[0])
    if len(c) == 3:
        return (c[0] + c[1] + c[2]) / 3.0
    if len(c) == 4:
        return (1 - c[0]) * (1 - c[3]) * 0.33 + (1 - c[1]) * (1 - c[3]) * 0.33 + (1 - c[2]) * (1 - c[3]) * 0.34
    return None


def operations(data: bytes):
    """(operator, operands), one after the other; what can't be read is passed over."""
    lex, held = Lexer(data), []
    while (x := lex.next()) is not None:
        if type(x) is not Op:
            held.append(x)
        elif x == "null":
            held.append(None)
        elif x == "BI":
            m = _INLINE_END.search(data, lex.at)
            lex.at = m.end() if m else len(data)
            yield "BI", []
            held = []
        elif x not in ("]", ">>", "{", "}"):
            yield str(x), held
            held = []


def content_of(f: File, x) -> bytes:
    x = f.get(x)
    parts = x if isinstance(x, list) else [x]
    return b"\n".join(f.decoded(s) for s in map(f.get, parts) if isinstance(s, Stream))


def resource(f: File, resources, kind: str, name):
    return f.get((f.get((f.get(resources) or {}).get(kind)) or {}).get(name))


class Font:
    """Widths and characters of a font's codes; unknown widths are those of Helvetica, or 500."""

    def __init__(self, f: File, d):
        d = d if isinstance(d, dict) else {}
        base = str(d.get("/BaseFont", ""))
        self.wide = d.get("/Subtype") == "/Type0"
        self.fixed = 600 if "Courier" in base else None
        self.widths: dict[int, float] = {}
        self.default = None
        inner = d
        if self.wide:
            inner = f.get((f.get(d.get("/DescendantFonts")) or [{}])[0]) or {}
            self.default = inner.get("/DW", 1000)
            w = f.get(inner.get("/W")) or []
            i = 0
            while i + 1 < len(w):
                more = f.get(w[i + 1])
                if isinstance(more, list):
                    self.widths |= {w[i] + k: x for k, x in enumerate(more)}
                    i += 2
                else:
                    self.widths |= dict.fromkeys(range(w[i], w[i + 1] + 1), w[i + 2]) if i + 2 < len(w) else {}
                    i += 3
        elif isinstance(widths := f.get(d.get("/Widths")), list):
            first = f.get(d.get("/FirstChar", 0))
            self.widths = {first + k: x for k, x in enumerate(map(f.get, widths)) if isinstance(x, (int, float))}
        descriptor = f.get(inner.get("/FontDescriptor")) or {}
        self.descent = min(0.0, float(f.get(descriptor.get("/Descent", -207 if "Courier" not in base else -157)) or 0)) / 1000
        self.chars: dict[int, str] = {}
        if isinstance(m := f.get(d.get("/ToUnicode")), Stream):
            self._to_unicode(f.decoded(m))
        encoding = f.get(d.get("/Encoding"))
        if isinstance(encoding, dict) and not self.chars:
            at = 0
            for x in f.get(encoding.get("/Differences")) or []:
                if isinstance(x, int):
                    at = x
                elif isinstance(x, Name):
                    if len(x) == 2:
                        self.chars[at] = x[1]
                    elif m := re.match(r"/uni([0-9A-F]{4})$", x):
                        self.chars[at] = chr(int(m[1], 16))
                    elif x == "/space":
                        self.chars[at] = " "
                    at += 1

    def _to_unicode(self, data: bytes) -> None:
        held: list = []
        for op, args in operations(data):
            held += args
            if op == "endbfchar":
                self.chars |= {int.from_bytes(a, "big"): b.decode("utf-16-be", "replace") for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif op == "endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                    if not (isinstance(a, bytes) and isinstance(b, bytes)):
                        continue
                    first, last = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for k in range(min(last - first, 65535) + 1):
                        if isinstance(c, list):
                            if k < len(c) and isinstance(c[k], bytes):
                                self.chars[first + k] = c[k].decode("utf-16-be", "replace")
                        elif isinstance(c, bytes) and c:
                            self.chars[first + k] = (c[:-2] + ((int.from_bytes(c[-2:], "big") + k) & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
            held = [] if op.startswith(("begin", "end")) else held

    def codes(self, raw: bytes) -> list[int]:
        return [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw), 2)] if self.wide else list(raw)

    def width(self, code: int) -> float:
        if code in self.widths:
            return self.widths[code] / 1000
        if self.default is not None:
            return self.default / 1000
        return (self.fixed or (_HELVETICA[code - 32] if 32 <= code < 127 else 500)) / 1000

    def char(self, code: int) -> str:
        if code in self.chars:
            return self.chars[code]
        return chr(code) if self.wide else _single(code)


@lru_cache(maxsize=256)
def _single(code: int) -> str:
    return bytes([code]).decode("cp1252", "replace")


class Page:
    """glyphs and covers of a page, in the order in which they are drawn."""

    def __init__(self, f: File, page: dict):
        self.f, self.fonts = f, {}
        self.glyphs: list[dict] = []
        self.covers: list[dict] = []
        self._run(content_of(f, page.get("/Contents")), page.get("/Resources"), (1, 0, 0, 1, 0, 0), (0.0,), True, 0)

    def _cover(self, kind: str, at, top: bool, bright: float | None) -> None:
        self.covers.append(dict(cover_id=len(self.covers), kind=kind, top_level=top, x0=at[0], y0=at[1], x1=at[2], y1=at[3], brightness=bright))

    def _font(self, resources, name) -> Font:
        d = resource(self.f, resources, "/Font", name)
        if id(d) not in self.fonts:
            self.fonts[id(d)] = Font(self.f, d), d
        return self.fonts[id(d)][0]

    def _run(self, data: bytes, resources, ctm, fill, top: bool, depth: int) -> None:
        f = self.f
        state = dict(ctm=ctm, fill=fill, font=None, size=0.0, tc=0.0, tw=0.0, tz=1.0, tl=0.0, ts=0.0)
        stack: list[dict] = []
        tm = line = (1, 0, 0, 1, 0, 0)
        path: list[tuple] = []

        def show(raw: bytes, tm):
            font, size = state["font"], state["size"]
            for code in font.codes(raw) if font else ():
                w = font.width(code)
                m = matrix(tm, state["ctm"])
                low = font.descent * size + state["ts"]
                x0, y0, x1, y1 = box(((0, low), (w * size * state["tz"], low + size)), m) if not (m[1] or m[2]) else box(((0, low), (w * size * state["tz"], low), (0, low + size), (w * size * state["tz"], low + size)), m)
                self.glyphs.append(dict(glyph_id=len(self.glyphs), ch=font.char(code), x0=x0, y0=y0, x1=x1, y1=y1, size=y1 - y0, brightness=brightness(state["fill"])))
                step = (w * size + state["tc"] + (state["tw"] if code == 32 and not font.wide else 0)) * state["tz"]
                tm = matrix((1, 0, 0, 1, step, 0), tm)
            return tm

        for op, a in operations(data):
            try:
                if op == "q":
                    stack.append(dict(state))
                elif op == "Q" and stack:
                    state = stack.pop()
                elif op == "cm":
                    state["ctm"] = matrix(tuple(a[:6]), state["ctm"])
                elif op == "BT":
                    tm = line = (1, 0, 0, 1, 0, 0)
                elif op == "Tf":
                    state["font"], state["size"] = self._font(resources, a[0]), float(a[1])
                elif op in ("Tc", "Tw", "TL", "Ts"):
                    state[op.lower()] = float(a[0])
                elif op == "Tz":
                    state["tz"] = a[0] / 100
                elif op in ("Td", "TD"):
                    if op == "TD":
                        state["tl"] = -a[1]
                    tm = line = matrix((1, 0, 0, 1, a[0], a[1]), line)
                elif op == "Tm":
                    tm = line = tuple(a[:6])
                elif op == "T*":
                    tm = line = matrix((1, 0, 0, 1, 0, -state["tl"]), line)
                elif op in ("'", '"'):
                    if op == '"':
                        state["tw"], state["tc"] = float(a[0]), float(a[1])
                    tm = line = matrix((1, 0, 0, 1, 0, -state["tl"]), line)
                    tm = show(a[-1], tm)
                elif op == "Tj":
                    tm = show(a[0], tm)
                elif op == "TJ":
                    for x in a[0]:
                        if isinstance(x, bytes):
                            tm = show(x, tm)
                        elif isinstance(x, (int, float)):
                            tm = matrix((1, 0, 0, 1, -x / 1000 * state["size"] * state["tz"], 0), tm)
                elif op in ("g", "rg", "k", "sc", "scn"):
                    state["fill"] = tuple(x for x in a if isinstance(x, (int, float)))
                elif op == "cs":
                    state["fill"] = (0.0,)
                elif op == "re":
                    x, y, w, h = a[:4]
                    path.append(("re", [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]))
                elif op == "m":
                    path.append(("m", [tuple(a[:2])]))
                elif op == "l" and path:
                    path[-1][1].append(tuple(a[:2]))
                elif op in ("c", "v", "y") and path:
                    path[-1] = ("curve", path[-1][1])
                elif op in ("f", "F", "f*", "B", "B*", "b", "b*"):
                    for kind, points in path:
                        if _is_rect(kind, points):
                            self._cover("rect", box(points, state["ctm"]), top, brightness(state["fill"]))
                    path = []
                elif op in ("S", "s", "n"):
                    path = []
                elif op == "BI":
                    self._cover("image", box(((0, 0), (1, 1), (0, 1), (1, 0)), state["ctm"]), False, None)
                elif op == "Do" and depth < _DEPTH:
                    x = resource(f, resources, "/XObject", a[0])
                    if isinstance(x, Stream) and f.get(x.attrs.get("/Subtype")) == "/Image":
                        self._cover("image", box(((0, 0), (1, 1), (0, 1), (1, 0)), state["ctm"]), False, None)
                    elif isinstance(x, Stream) and f.get(x.attrs.get("/Subtype")) == "/Form":
                        m = matrix(tuple(map(f.get, f.get(x.attrs.get("/Matrix")) or (1, 0, 0, 1, 0, 0))), state["ctm"])
                        before = len(self.covers)
                        self._run(f.decoded(x), x.attrs.get("/Resources") or resources, m, state["fill"], False, depth + 1)
                        b = list(map(f.get, f.get(x.attrs.get("/BBox")) or (0, 0, 0, 0)))
                        if len(self.covers) == before:  # a figure without any cover is taken for one
                            self._cover("image", box(((b[0], b[1]), (b[2], b[1]), (b[0], b[3]), (b[2], b[3])), m), False, None)
            except (TypeError, IndexError, ValueError, KeyError, AttributeError, OverflowError):
                continue  # an operator with operands that it can't take


def _is_rect(kind: str, points) -> bool:
    if kind == "re":
        return True
    if kind != "m":
        return False
    points = points[:-1] if len(points) == 5 and points[0] == points[-1] else points
    if len(points) != 4:
        return False
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = points
    return (ax == bx and by == cy and cx == dx and dy == ay) or (ay == by and bx == cx and cy == dy and dx == ax)


def shown(a) -> bytes | None:
    parts = [x for y in a for x in (y if isinstance(y, list) else [y]) if isinstance(x, bytes)]
    return b"".join(parts) if parts else None


def text_operators(f: File, page: dict) -> list[dict]:
    """Operators of a page that set, save or use the text mode; each form once, between FORM_BEGIN and FORM_END."""
    out: list[dict] = []
    seen: set[int] = set()

    def add(op: str, depth: int, value: int | None = None, text: bytes | None = None) -> None:
        out.append(dict(seq=len(out), op=op, int_arg=value, shown=text, depth=depth))

    def walk(data: bytes, resources, depth: int) -> None:
        for op, a in operations(data):
            if op in ("q", "Q"):
                add(op, depth)
            elif op == "Tr":
                ok = bool(a) and isinstance(a[-1], (int, float)) and not isinstance(a[-1], bool)
                add(op, depth, int(a[-1]) if ok else None)
            elif op in _SHOWS:
                add(op, depth, None, shown(a))
            elif op == "Do" and a and depth < _DEPTH:
                x = resource(f, resources, "/XObject", a[0])
                if isinstance(x, Stream) and f.get(x.attrs.get("/Subtype")) == "/Form" and id(x) not in seen:
                    seen.add(id(x))
                    add("FORM_BEGIN", depth)
                    try:
                        walk(f.decoded(x), x.attrs.get("/Resources") or resources, depth + 1)
                    except PdfError:
                        pass  # a form that can't be decoded shows nothing
                    add("FORM_END", depth)

    walk(content_of(f, page.get("/Contents")), page.get("/Resources"), 0)
    return out
