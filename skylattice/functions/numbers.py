"""Arithmetic of frames, boxes, windows, ranks and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks at which recall is read, and the answers a query may give (fixed values).
CUTS, BUDGET = (1, 5, 20, 50, 100), 100
SPREAD_STEP, SPREAD_LEAST, SPREAD_MOST = 10, 3, 20
BOX_PAD, BOX_LEAST = 0.06, 0.01


def frame_ms(frame_idx: Column, fps: Column) -> Column:
    return frame_idx / fps * 1000.0


def box_area(box: Column) -> Column:
    """Area of [ymin, xmin, ymax, xmax]."""
    return (box[2] - box[0]) * (box[3] - box[1])


def pixel_box(box: Column, width: Column, height: Column, pad: float = BOX_PAD) -> Column:
    """(left, top, right, bottom) pixels of a padded and clamped box."""
    dy, dx = (box[2] - box[0]) * pad, (box[3] - box[1]) * pad
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    whole = lambda v, n: (inside(v) * n).cast("int")
    return F.struct(whole(box[1] - dx, width).alias("left"), whole(box[0] - dy, height).alias("top"), whole(box[3] + dx, width).alias("right"), whole(box[2] + dy, height).alias("bottom"))


def interval_length(s: Column, e: Column) -> Column:
    return e - s + 1


def half_widths(length: int) -> tuple[int, int]:
    """Frames before and after the centre of a window of that length."""
    if length < 1:
        raise ValueError(f"window length must be positive: {length}")
    return (length - 1) // 2, length // 2


def uniform_grid(center: Column, m: int, step: int, lo: Column | None = None, hi: Column | None = None) -> Column:
    """m frames `step` apart around the centre, clamped, distinct, ascending."""
    if m < 1 or step < 1:
        raise ValueError("m and step must be positive")
    start = center - (m - 1) // 2 * step
    low = lo if lo is not None else F.lit(0)
    points = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.greatest(low, start + i * step))
    if hi is not None:
        points = F.transform(points, lambda x: F.least(hi, x))
    return F.array_sort(F.array_distinct(points))


def spread_in_window(center: Column, lo: Column, hi: Column, m: Column) -> Column:
    """m even points of [lo, hi], half-even rounding, distinct, nearest to the centre first."""
    points = F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(2)) - 1), lambda i: F.bround(lo + i * ((hi - lo) / (F.greatest(m, F.lit(2)) - 1))).cast("int"))
    near = F.array_sort(F.transform(F.array_distinct(points), lambda f: F.struct(F.abs(f - center).alias("d"), f.alias("f"))))
    return F.when((m == 1) | (hi <= lo), F.array(center.cast("int"))).otherwise(F.transform(near, lambda x: x["f"]))


def adaptive_m(lo: Column, hi: Column, step: int = SPREAD_STEP) -> Column:
    return F.least(F.lit(SPREAD_MOST), F.greatest(F.lit(SPREAD_LEAST), F.bround((hi - lo + 1) / step).cast("int") + 1))


def guaranteed_span(m: Column, step: Column) -> Column:
    return m * step


def grid_hits(frames: Column, s: Column, e: Column) -> Column:
    return F.exists(frames, lambda f: f.between(s, e))


def slot_weight(rank: Column) -> Column:
    """Share of the cuts that count an answer at this rank."""
    return F.size(F.filter(F.array(*map(F.lit, CUTS)), lambda k: k >= rank)) / float(len(CUTS))


def lpt_bound(m: Column) -> Column:
    """How far from the optimum greedy balancing over m shards can be."""
    return 4.0 / 3 - 1.0 / (3 * m)


def projected_cost(frames: Column, fps: Column, usd_per_hour: Column, containers: Column) -> Column:
    """More containers buy wall time; the price of the work stays."""
    seconds = frames / fps
    return F.struct(
        F.round(seconds, 1).alias("container_seconds"), F.round(seconds / containers, 1).alias("wall_clock_seconds"), F.round(seconds / 3600 * usd_per_hour, 4).alias("usd"),
        F.round(1000 / fps / 3600 * usd_per_hour, 5).alias("usd_per_1000_frames"),
    )


def choose_device(cpu_usd: Column, cpu_wall: Column, gpu_usd: Column, gpu_wall: Column, least_speedup: float = 3.0) -> Column:
    return F.when(gpu_usd <= cpu_usd, "gpu").when((gpu_wall <= 0) | (cpu_wall / gpu_wall >= least_speedup), "gpu").otherwise("cpu")
