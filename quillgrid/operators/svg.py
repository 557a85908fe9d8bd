"""Charts as SVG text, from aggregates that are small enough to draw."""

from __future__ import annotations

import math
from xml.sax.saxutils import escape

from . import charts


def bars(rows: list[tuple[str, float]], width: int = 640, height: int = 400, title: str = "") -> str:
    """A bar for each (label, value)."""
    top = max([v for _, v in rows] + [0.0])
    low = min([v for _, v in rows] + [0.0])
    low, top = charts.padded(low, top)
    y = lambda v: height - 30 - (v - low) / (top - low) * (height - 60)
    step = (width - 60) / max(1, len(rows))
    body = [f'<text x="{width / 2:g}" y="18" text-anchor="middle">{escape(title)}</text>'] if title else []
    for t in charts.ticks(low, top):
        body.append(f'<line x1="50" x2="{width - 10}" y1="{y(t):.2f}" y2="{y(t):.2f}" stroke="#ddd"/><text x="46" y="{y(t) + 4:.2f}" text-anchor="end">{t:g}</text>')
    for k, (label, v) in enumerate(rows):
        a, b = sorted((y(v), y(max(low, 0.0))))
        body.append(f'<rect x="{50 + k * step + 1:.2f}" y="{a:.2f}" width="{max(1.0, step - 2):.2f}" height="{b - a:.2f}" fill="#4878a8"/><text x="{50 + (k + 0.5) * step:.2f}" y="{height - 14}" text-anchor="middle">{escape(str(label))}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">{"".join(body)}</svg>'


def line(points: list[tuple[float, float]], width: int = 640, height: int = 400) -> str:
    """A line through the points in order of x."""
    points = sorted(points)
    x0, x1 = charts.padded(points[0][0], points[-1][0]) if points else (0.0, 1.0)
    y0, y1 = charts.padded(min((v for _, v in points), default=0.0), max((v for _, v in points), default=1.0))
    at = " ".join(f"{50 + (x - x0) / (x1 - x0) * (width - 60):.2f},{height - 30 - (v - y0) / (y1 - y0) * (height - 60):.2f}" for x, v in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><polyline fill="none" stroke="#4878a8" points="{at}"/></svg>'


#: Colours of series, in order.
COLOURS = ("#4878a8", "#d1605e", "#6a9f58", "#967662", "#b8b0ac", "#e7ca60")


def series(lines: dict[str, list[tuple[float, float]]], kind: str = "line", log_y: bool = False, title: str = "", width: int = 640, height: int = 400) -> str:
    """Several named series with axes and a legend, as lines or (``scatter``) as points; ``log_y`` leaves out what isn't positive."""
    shown = {n: sorted((x, v) for x, v in spots if not log_y or v > 0) for n, spots in lines.items()}
    every = [s for spots in shown.values() for s in spots]
    scale = math.log10 if log_y else float
    x0, x1 = charts.padded(min((x for x, _ in every), default=0.0), max((x for x, _ in every), default=1.0))
    low, high = min((v for _, v in every), default=1.0), max((v for _, v in every), default=1.0)
    y0, y1 = charts.padded(scale(low), scale(high))
    px = lambda x: 50 + (x - x0) / (x1 - x0) * (width - 60)
    py = lambda v: height - 30 - (scale(v) - y0) / (y1 - y0) * (height - 60)
    body = [f'<text x="{width / 2:g}" y="18" text-anchor="middle">{escape(title)}</text>'] if title else []
    for t in charts.log_ticks(low, high) if log_y else charts.ticks(low, high):
        if y0 <= scale(t) <= y1:
            body.append(f'<line x1="50" x2="{width - 10}" y1="{py(t):.2f}" y2="{py(t):.2f}" stroke="#ddd"/><text x="46" y="{py(t) + 4:.2f}" text-anchor="end">{t:g}</text>')
    for k, (name, spots) in enumerate(shown.items()):
        colour = COLOURS[k % len(COLOURS)]
        if kind == "scatter":
            body += [f'<circle cx="{px(x):.2f}" cy="{py(v):.2f}" r="2.5" fill="{colour}"/>' for x, v in spots]
        else:
            at = " ".join(f"{px(x):.2f},{py(v):.2f}" for x, v in spots)
            body.append(f'<polyline fill="none" stroke="{colour}" points="{at}"/>')
        if len(shown) > 1:
            body.append(f'<text x="{width - 14}" y="{30 + 14 * k}" text-anchor="end" fill="{colour}">{escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11">{"".join(body)}</svg>'
