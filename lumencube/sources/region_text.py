"""Regions as text in the CRTF and DS9 formats, in pixel coordinates."""

from __future__ import annotations

import math
import re

from ..operators.regions import Region

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_UNSUPPORTED = ("projection", "annulus", "panda", "epanda", "bpanda", "composite")


def _n(x: float) -> str:
    return f"{x:.4f}"


def _points(numbers: list[float]) -> tuple[tuple[float, float], ...]:
    return tuple(zip(numbers[::2], numbers[1::2], strict=False))


def to_ds9(regions: list[Region]) -> str:
    """Pixel positions are 1-based; ellipse radii are given as x, y."""
    lines = ["# Region file format: DS9", "image"]
    for r in regions:
        kind, p = r.kind.removeprefix("ann_"), r.points
        at = ", ".join(_n(c + 1) for q in p for c in q)
        if kind == "rectangle":
            text = f"box({_n(p[0][0] + 1)}, {_n(p[0][1] + 1)}, {_n(p[1][0])}, {_n(p[1][1])}, {r.rotation:g})"
        elif kind == "ellipse":
            center = f"{_n(p[0][0] + 1)}, {_n(p[0][1] + 1)}"
            angle = f", {r.rotation:g}" if r.rotation else ""
            text = f'circle({center}, {_n(p[1][0])}")' if p[1][0] == p[1][1] else f"ellipse({center}, {_n(p[1][1])}, {_n(p[1][0])}{angle})"
        else:
            text = f"{kind}({at})"
        lines.append(("# " if kind in ("polyline", "vector", "ruler", "compass", "text") else "") + text)
    return "\n".join(lines) + "\n"


def from_ds9(text: str) -> tuple[list[Region], list[str]]:
    """Regions and messages. Blank lines, remarks and excluded shapes are skipped; unknown frames drop what follows."""
    out, said, known = [], [], True
    for line in re.split(r"[\n;]", text):
        line = line.strip()
        if line.startswith("# ") and "(" in line:
            line = line[2:]
        if not line or line[0] in "#-" or line.startswith("global"):
            continue
        name = line.split("(")[0].strip().lower().lstrip("+")
        if "(" not in line:
            known = name in ("image", "physical", "pixel")
            if not known:
                said.append(f"coordinate system {name} is not supported")
            continue
        if not known:
            continue
        body = line[line.index("(") + 1 :].split(")")[0]
        v = [float(x) for x in _NUMBER.findall(body)]
        if name in _UNSUPPORTED:
            said.append(f"{name} is not supported")
            continue
        move = lambda n: tuple((x - 1, y - 1) for x, y in _points(v[:n]))
        if name == "box" and len(v) >= 4:
            out.append(Region("rectangle", (*move(2), (v[2], v[3])), v[4] if len(v) > 4 else 0.0))
        elif name == "circle" and len(v) >= 3:
            out.append(Region("ellipse", (*move(2), (v[2], v[2]))))
        elif name == "ellipse" and len(v) >= 4:
            out.append(Region("ellipse", (*move(2), (v[3], v[2])), v[4] if len(v) > 4 else 0.0))
        elif name in ("point", "line", "polyline", "polygon"):
            out.append(Region(name, move(len(v))))
        elif name in ("segment",):
            out.append(Region("polyline", move(len(v))))
        elif name in ("text", "textbox", "vector", "ruler", "compass"):
            out.append(Region(f"ann_{name}", move(min(len(v), 4))))
        else:
            said.append(f"{name} cannot be read")
    if not out and not said:
        said.append("zero regions set")
    return out, said


def to_crtf(regions: list[Region]) -> str:
    """Pixel positions are 0-based; the ellipse angle is the rotation less 90 degrees."""
    lines = ["#CRTFv0"]
    pair = lambda p: f"[{_n(p[0])}pix, {_n(p[1])}pix]"
    for r in regions:
        kind, p = r.kind.removeprefix("ann_"), r.points
        if kind == "rectangle":
            text = f"rotbox[{pair(p[0])}, {pair(p[1])}, {r.rotation:g}deg]" if r.rotation else f"centerbox[{pair(p[0])}, {pair(p[1])}]"
        elif kind == "ellipse":
            angle = (r.rotation - 90) % 360
            text = f"circle[{pair(p[0])}, {_n(p[1][0])}pix]" if p[1][0] == p[1][1] else f"ellipse[{pair(p[0])}, {pair(p[1])}, {angle:g}deg]"
        elif kind == "point":
            text = f"symbol[{pair(p[0])}, .]"
        else:
            text = f"{'poly' if kind == 'polygon' else kind}[{', '.join(pair(q) for q in p)}]"
        lines.append(("ann " if r.kind.startswith("ann_") else "") + text + " coord=pixel")
    return "\n".join(lines) + "\n"


def from_crtf(text: str) -> tuple[list[Region], list[str]]:
    out, said = [], []
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] == "#" or line.startswith(("global", "-")):
            continue
        prefix = "ann_" if line.startswith("ann ") else ""
        m = re.match(r"(?:ann\s+)?([a-z]+)\s*\[(.*)\]", line)
        if not m:
            said.append(f"cannot read: {line}")
            continue
        name, v = m[1], [float(x) for x in _NUMBER.findall(m[2])]
        if "box" in name:
            if name == "box":
                (ax, ay), (bx, by) = _points(v[:4])
                out.append(Region(prefix + "rectangle", (((ax + bx) / 2, (ay + by) / 2), (abs(bx - ax), abs(by - ay)))))
            else:
                out.append(Region(prefix + "rectangle", _points(v[:4]), v[4] if len(v) > 4 else 0.0))
        elif name == "circle":
            out.append(Region(prefix + "ellipse", ((v[0], v[1]), (v[2], v[2]))))
        elif name == "ellipse":
            out.append(Region(prefix + "ellipse", _points(v[:4]), (v[4] + 90) % 360 if len(v) > 4 else 0.0))
        elif name == "symbol":
            out.append(Region(prefix + "point", _points(v[:2])))
        elif "poly" in name:
            out.append(Region(prefix + ("polyline" if name == "polyline" else "polygon"), _points(v)))
        elif name in ("line", "vector", "ruler"):
            out.append(Region("line" if name == "line" and not prefix else f"ann_{name}", _points(v[:4])))
        elif name == "text":
            out.append(Region("ann_text", _points(v[:2])))
        else:
            said.append(f"{name} is not supported")
    if not out and not said:
        said.append("zero regions set")
    return out, said


def same(a: Region, b: Region, tol: float = 1e-3) -> bool:
    turn = abs((a.rotation - b.rotation + 180) % 360 - 180)
    return a.kind == b.kind and turn <= tol and len(a.points) == len(b.points) and all(math.dist(p, q) <= tol for p, q in zip(a.points, b.points, strict=True))
