"""Captured events: changes, repeats, fused directions, remapped ids, elapsed time, merged sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lookups import lookup
from ..schemas import DIRECTION_BUTTONS


def changes(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from those of the row before, with the first row of each key. Nulls equal nulls."""
    before = Window.partitionBy(*keys).orderBy(*order)
    same = F.lag(F.struct(*values)).over(before).eqNullSafe(F.struct(*values))
    return df.withColumn("_same", same).where("NOT _same").drop("_same")


def rising(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows where value turns from 0 to 1; a key starts at 0."""
    return df.withColumn("_p", F.lag(value, 1, 0).over(Window.partitionBy(*keys).orderBy(*order))).where((F.col(value) == 1) & (F.col("_p") == 0)).drop("_p")


def suppress_repeats(df: DataFrame, keys: list[str], order: list[str], values: list[str], time: str, within: float) -> DataFrame:
    """Without rows that equal the last row kept and come less than `within` after it. Times ascend in the order.

    A row unlike the one before, or at least `within` after it, is kept for sure; the window marks these. What is left to
    decide needs the last row kept, so one pass over the sorted rows does, batch by batch: linear, and it holds one time.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    sure = ~(F.lag(F.struct(*values)).over(w).eqNullSafe(F.struct(*values)) & (F.col(time) - F.lag(time).over(w) < within))
    marked = df.withColumn("_sure", F.coalesce(sure, F.lit(True))).sortWithinPartitions(*keys, *order)  # as the window leaves them
    at, n = df.columns.index(time), len(df.columns)

    def run(batches):
        last = None
        for b in batches:
            keep = []
            for known, t in zip(b.column(n).to_pylist(), b.column(at).to_pylist()):
                keep.append(known or t - last >= within)
                if keep[-1]:
                    last = t
            yield b.select(range(n)).filter(pa.array(keep, pa.bool_()))

    return marked.mapInArrow(run, df.schema)


def fuse_axis(hat: Column, pad: Column, stick: Column, dead: float = 0.5) -> Column:
    """One axis of a direction: the hat, else the pad's buttons, else the stick's sign beyond the dead zone."""
    zero = F.lit(0)
    side = F.when(F.abs(stick) > dead, F.signum(stick).cast("int")).otherwise(zero)
    return F.coalesce(F.nullif(hat, zero), F.nullif(pad, zero), side)


def direction(buttons: Column, axes: Column, hats: Column, dead: float = 0.5) -> tuple[Column, Column]:
    """Both axes of a pad's direction: the first hat, else the four buttons (only on pads of more than 11), else the
    stick (only on pads of two axes and more), whose y points down. buttons: array<int>, axes: array<double>, hats:
    array<struct<x, y>>; missing entries are 0."""
    down = lambda i: F.coalesce(F.get(buttons, F.lit(i)), F.lit(0))
    pad = lambda plus, minus: F.when(F.size(buttons) > 11, down(plus) - down(minus)).otherwise(0)
    stick = lambda i: F.when(F.size(axes) >= 2, F.coalesce(F.get(axes, F.lit(i)), F.lit(0.0))).otherwise(0.0)
    hat = lambda c: F.coalesce(F.get(hats, F.lit(0))[c], F.lit(0))
    left, right = DIRECTION_BUTTONS["x"], DIRECTION_BUTTONS["y"]
    return fuse_axis(hat("x"), pad(*left), stick(0), dead), fuse_axis(hat("y"), pad(*right), -stick(1), dead)


def pad_events(snapshots: DataFrame, keys: list[str], order: list[str], mapping: dict[int, int] | None = None, mask: str = "always") -> DataFrame:
    """(keys, order, pos, type, id, val, hx, hy): what changed from one snapshot (buttons, axes, hats) of a pad to the next.

    First the direction as hat 0, then the other hats, then the buttons by number, their ids mapped. All begin at rest.
    Buttons that make up the direction are left out: always, or, with mask "while_down", while one of them is down (the
    release of the last one then comes through). One sort by key; the rest is local to a row.
    """
    if mask not in ("always", "while_down"):
        raise ValueError(f"mask is always or while_down, not {mask}")
    hx, hy = direction(F.col("buttons"), F.col("axes"), F.col("hats"))
    w, none, ids = Window.partitionBy(*keys).orderBy(*order), F.lit(None).cast("int"), [i for pair in DIRECTION_BUTTONS.values() for i in pair]
    s = snapshots.withColumn("_h", F.struct(hx.cast("int").alias("x"), hy.cast("int").alias("y")))
    s = s.withColumns({f"_{c}": F.lag(c).over(w) for c in ("buttons", "hats", "_h")})
    event = lambda kind, i, val, x, y: F.struct(F.lit(kind).alias("type"), i.cast("int").alias("id"), val.cast("int").alias("val"), x.cast("int").alias("hx"), y.cast("int").alias("hy"))
    rest = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    turned = F.when(F.col("_h") != F.coalesce("__h", rest), F.array(event("hat", F.lit(0), none, F.col("_h.x"), F.col("_h.y"))))
    pair = lambda v: F.struct(F.coalesce(v["x"], F.lit(0)).alias("x"), F.coalesce(v["y"], F.lit(0)).alias("y"))
    other = F.filter(F.transform("hats", lambda v, i: F.when((i > 0) & (pair(v) != pair(F.get("_hats", i))), event("hat", i, none, pair(v)["x"], pair(v)["y"]))), lambda e: e.isNotNull())
    held = F.exists(F.array(*[F.coalesce(F.get("buttons", F.lit(i)), F.lit(0)) != 0 for i in ids]), lambda x: x)
    masked = F.lit(True) if mask == "always" else (F.size("buttons") > 11) & held
    value = lambda name, i: F.coalesce(F.get(name, i), F.lit(0))
    pressed = F.transform("buttons", lambda v, i: F.when((value("buttons", i) != value("_buttons", i)) & ~(i.isin(ids) & masked), event("btn", remap(i, mapping or {}), value("buttons", i), none, none)))
    empty = F.slice(F.array(event("hat", F.lit(0), none, none, none)), 1, 0)
    all_ = F.concat(*[F.coalesce(x, empty) for x in (turned, other, F.filter(pressed, lambda e: e.isNotNull()))])
    return s.select(*keys, *order, F.posexplode(all_).alias("pos", "e")).select(*keys, *order, "pos", "e.*")


def known_ids(events: DataFrame, least: int = 0, most: int = 10) -> DataFrame:
    """Without button events whose id is out of the range that a sink knows; other events stay."""
    return events.where((F.col("type") != "btn") | F.col("id").between(least, most))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value so far, this row's included."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def on_ticks(tick: Column, every: int) -> Column:
    """Whether a tick is one of each `every`."""
    return tick % every == 0


def triggered(presses: DataFrame, slots: DataFrame) -> DataFrame:
    """presses(code, ...) with slot and macro_idx of each bound slot of their code; slots: (slot, code, macro_idx), a short
    list by nature; macro_idx below 0 is unbound."""
    return presses.join(slots.where("macro_idx >= 0"), "code")


def brackets(df: DataFrame, keys: list[str], order: list[str], kind: str) -> DataFrame:
    """Rows between a start and the next stop, with the number of their session. A start while a session runs is refused,
    a stop while none runs is ignored, rows outside go, and so do sessions without rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    control = F.when(F.col(kind).isin("start", "stop"), F.col(kind))
    s = df.withColumn("_on", F.coalesce(F.last(control, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "start", F.lit(False)))
    opens = ((F.col(kind) == "start") & ~F.col("_on")).cast("int")
    s = s.withColumn("session", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.where(F.col("_on") & ~F.coalesce(F.col(kind).isin("start", "stop"), F.lit(False))).drop("_on")


def remap(ids: Column, mapping: dict[int, int]) -> Column:
    """The id's image, or the id itself."""
    return lookup(mapping, ids, ids)


def elapsed(df: DataFrame, keys: list[str], micros: Column, name: str = "t") -> DataFrame:
    """df with the milliseconds since the key's first row, to one decimal. micros are whole numbers, so differences are exact."""
    return df.withColumn("_us", micros).withColumn(name, F.bround((F.col("_us") - F.min("_us").over(Window.partitionBy(*keys))) / 1000, 1)).drop("_us")


def merge_sources(first: DataFrame, second: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of both sources in arrival order, numbered from 1 as seq; the first source goes first in ties."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    return both.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "source")))


def sessions(df: DataFrame, keys: list[str], order: list[str], start: Column) -> DataFrame:
    """df with the number of its session: how many starts came so far."""
    return df.withColumn("session", F.sum(F.when(start, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def debounce(df: DataFrame, keys: list[str], time: str, order: list[str], gap: str) -> DataFrame:
    """The last row of each burst: rows follow one another by less than gap."""
    row = F.struct(*order, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    last = df.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(F.max(row).alias("_r"))
    return last.select(*[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(df.columns)])
