"""Box arithmetic as Column expressions (coordinates 0 to 1000)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))


def finite(*values: Column) -> Column:
    """Whether all are numbers: neither null nor NaN nor infinite."""
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
    return out


def normalise(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """Clamped to 0..1000 with each pair sorted; all null if one is not a finite number."""
    good = finite(x0, y0, x1, y1)
    a, b, c, d = (clamp(v, 0, 1000) for v in (x0, y0, x1, y1))
    return tuple(F.when(good, v) for v in (F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d)))


def to_page(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A box of 0..1000 as points of a page."""
    x0, y0, x1, y1 = normalise(*box)
    return width * x0 / 1000, height * y0 / 1000, width * x1 / 1000, height * y1 / 1000


def from_page(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """Points of a page as a box of 0..1000, cut to the page, rounded half even to three places."""
    cut = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    part = lambda v, top: F.bround(1000 * cut(v, top) / F.greatest(F.lit(1.0), top), 3)
    x0, y0, x1, y1 = box
    return part(x0, width), part(y0, height), part(x1, width), part(y1, height)


def probe(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """The box in which a figure is looked for: at least 28 % by 20 % of the page, 180 points at most of that, about the
    box's centre (the page's where the box is empty), cut to the page."""
    x0, y0, x1, y1 = box
    wide, tall = x1 - x0, y1 - y0
    cx = F.when(wide > 0, (x0 + x1) / 2).otherwise(width / 2)
    cy = F.when(tall > 0, (y0 + y1) / 2).otherwise(height / 2)
    w = F.greatest(wide, F.least(width * 0.28, F.lit(180.0)))
    h = F.greatest(tall, F.least(height * 0.20, F.lit(180.0)))
    zero = F.lit(0.0)
    return F.greatest(zero, cx - w / 2), F.greatest(zero, cy - h / 2), F.least(width, cx + w / 2), F.least(height, cy + h / 2)


def figure_source(coverage: Column, text_chars: Column, drawings: Column) -> Column:
    """raster for a visual that an image covers and that holds next to no text or drawing; else vector_or_mixed."""
    raster = (coverage >= 0.86) & (text_chars <= 3) & (drawings <= 1)
    return F.when(F.coalesce(raster, F.lit(False)), "raster").otherwise("vector_or_mixed")


def paragraph_indent(decision: Column, em: Column) -> Column:
    """The first-line indent of a paragraph in em: measured, 0.45 to 1.8, where the layout says yes (1 if not measured),
    0 where it says no, null where it does not say."""
    return F.when(decision == "yes", F.bround(clamp(F.coalesce(em, F.lit(1.0)), 0.45, 1.8), 2)).when(decision == "no", 0.0)


def style_of(bold: Column, italic: Column) -> Column:
    """The style of recovered text by the shares of its bold and italic characters."""
    return F.when(bold >= 0.62, "bold").when(italic >= 0.62, "italic").otherwise("normal")


def scaled_percent(low: int, span: int, top: int, part: Column) -> Column:
    """A stage's share of progress: ``low`` and ``span`` times the part done (half even), ``top`` at most."""
    return F.least(F.lit(top), F.lit(low) + F.bround(span * part).cast("int"))


def mebibytes(n: Column) -> Column:
    return n / (1024 * 1024)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), (x1 - x0) * (y1 - y0))


def overlap(a: str, b: str) -> Column:
    """Intersection area of the boxes of two aliases."""
    c = F.col
    w = F.least(c(f"{a}.x1"), c(f"{b}.x1")) - F.greatest(c(f"{a}.x0"), c(f"{b}.x0"))
    h = F.least(c(f"{a}.y1"), c(f"{b}.y1")) - F.greatest(c(f"{a}.y0"), c(f"{b}.y0"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def column_of(x0: Column, x1: Column, flow: Column) -> Column:
    centre = (x0 + x1) / 2
    return (
        F.when(flow <= 1, "auto").when(x1 - x0 >= 720, "full")
        .when(flow == 2, F.when(centre < 500, "column1").otherwise("column2"))
        .when(centre < 333, "column1").when(centre < 667, "column2").otherwise("column3")
    )


def width_ratio(x0: Column, x1: Column, column: Column, flow: Column, page: float = 612.0, left: float = 55.0, right: float = 55.0, gap: float = 18.0) -> Column:
    """A visual's width relative to its column, 0.16 to 0.995."""
    text = max(72.0, page - left - right)
    n = F.greatest(F.lit(1), F.least(F.lit(3), flow))
    reference = F.when((column == "full") | (n == 1), F.lit(text)).otherwise((F.lit(text) - gap * (n - 1)) / n)
    return F.when(reference <= 1, 0.93).otherwise(clamp(page * F.greatest(F.lit(0.0), x1 - x0) / 1000 / reference, 0.16, 0.995))


def caption_alignment(cap0: Column, cap1: Column, vis0: Column, vis1: Column) -> Column:
    cap, vis = F.greatest(F.lit(1.0), cap1 - cap0), F.greatest(F.lit(1.0), vis1 - vis0)
    tolerance = clamp(vis * 0.055, 14, 34)
    return (
        F.when(vis0.isNull(), "left")
        .when((cap <= vis * 0.88) & (F.abs((cap0 + cap1) / 2 - (vis0 + vis1) / 2) <= tolerance), "center")
        .when(F.abs(cap0 - vis0) <= tolerance, "left").when(F.abs(cap1 - vis1) <= tolerance, "right").otherwise("left")
    )


def caption_size(source: Column, body: float, detected: float) -> Column:
    return F.when(source > 0, clamp(source * body / max(1.0, detected), 6.2, body * 1.06)).otherwise(max(6.2, body * 0.9))
