"""A scatter chart of services as SVG text, from a few rows brought to the driver."""

from __future__ import annotations

from html import escape

WIDTH, HEIGHT, EDGE = 900, 560, 60


def scatter(points: list[dict], frontier: list[dict], x: str, y: str, title: str) -> str:
    """Points (label, x, y) with the frontier as a line through its points; both axes begin at 0."""
    known = [p for p in points if p[x] is not None and p[y] is not None]
    top_x, top_y = (1.05 * max((p[c] for p in known), default=1.0) or 1.0 for c in (x, y))
    at_x = lambda v: EDGE + (WIDTH - 2 * EDGE) * v / top_x
    at_y = lambda v: HEIGHT - EDGE - (HEIGHT - 2 * EDGE) * v / top_y
    text = lambda px, py, words, anchor="start": f'<text x="{px:.1f}" y="{py:.1f}" text-anchor="{anchor}">{escape(words)}</text>'
    parts = [
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">',
        f'<rect width="{WIDTH}" height="{HEIGHT}" fill="white"/>', text(WIDTH / 2, EDGE / 2, title, "middle"),
        f'<path d="M{EDGE},{EDGE} V{HEIGHT - EDGE} H{WIDTH - EDGE}" fill="none" stroke="black"/>',
        text(WIDTH / 2, HEIGHT - EDGE / 4, x, "middle"), text(EDGE / 4, EDGE - 8, y),
    ]
    for k in range(5):
        parts.append(text(at_x(top_x * k / 4), HEIGHT - EDGE + 16, f"{top_x * k / 4:.3g}", "middle"))
        parts.append(text(EDGE - 6, at_y(top_y * k / 4) + 4, f"{top_y * k / 4:.3g}", "end"))
    line = " L".join(f"{at_x(p[x]):.1f},{at_y(p[y]):.1f}" for p in sorted(frontier, key=lambda p: (p[x], -p[y])))
    parts.append(f'<path d="M{line}" fill="none" stroke="#1f77b4"/>' if line else "")
    for p in known:
        fill = "#1f77b4" if p in frontier else "#999999"
        parts.append(f'<circle cx="{at_x(p[x]):.1f}" cy="{at_y(p[y]):.1f}" r="4" fill="{fill}"/>')
        parts.append(text(at_x(p[x]) + 6, at_y(p[y]) - 6, p["label"]))
    return "\n".join([*parts, "</svg>"]) + "\n"
