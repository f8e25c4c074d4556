"""Steps and events: compile, decode, normalise, display, construct. Tables carry (macro_id, seq); seq is the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..schemas import NEUTRAL, STEP, TAP


def _or(name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _filled(steps: DataFrame) -> DataFrame:
    return steps.withColumns({"type": _or("type", "wait"), "delay": _or("delay", 0.0), "dir": _or("dir", NEUTRAL), "btn": _or("btn", "A"), **{c: _or(c, v) for c, v in TAP.items()}})


def new_steps(rows: DataFrame) -> DataFrame:
    """Steps of rows with a type and any of the other fields: each type keeps its own fields, defaults filled in."""
    own = {"delay": ("wait", 0.0), "dir": ("dir", NEUTRAL), "btn": ("press release tap", "A"), "text": ("comment", ""), **{c: ("tap", v) for c, v in TAP.items()}}
    return rows.withColumns({c: F.when(F.col("type").isin(kinds.split()), _or(c, v)) for c, (kinds, v) in own.items()})


def compile_steps(steps: DataFrame, mirror: bool = False) -> DataFrame:
    """Timed events of steps. A running clock adds each step's delay and a tap's length; a tap gives, for each
    repetition, presses of all buttons, then releases. One sort for each macro; expansion is local to a row."""
    s = _filled(steps).where("type <> 'comment'")
    reps = F.greatest(F.col("rep"), F.lit(0))
    length = F.when((F.col("type") == "tap") & (reps > 0), reps * F.col("dur") + (reps - 1) * F.col("gap")).otherwise(0)
    clock = Window.partitionBy("macro_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_len", length).withColumn("_t", F.sum(F.col("delay") + F.col("_len")).over(clock) - F.col("_len"))
    name = L.mirror_name(F.col("dir")) if mirror else F.col("dir")
    none = F.lit(None).cast("int")
    event = lambda t, kind, i, val, x, y: F.struct(t.alias("t"), F.lit(kind).alias("type"), i.alias("id"), val.alias("val"), x.alias("hx"), y.alias("hy"))
    buttons = lambda t, val: F.transform(L.button_ids(F.col("btn")), lambda b: event(t, "btn", b, F.lit(val), none, none))
    at = lambda r: F.col("_t") + r * (F.col("dur") + F.col("gap"))
    taps = F.flatten(F.transform(F.sequence(F.lit(0), reps - 1), lambda r: F.concat(buttons(at(r), 1), buttons(at(r) + F.col("dur"), 0))))
    hat = F.array(event(F.col("_t"), "hat", F.lit(0), none, L.direction_x(name), L.direction_y(name)))
    out = F.when(F.col("type") == "dir", hat).when(F.col("type") == "press", buttons(F.col("_t"), 1)).when(F.col("type") == "release", buttons(F.col("_t"), 0))
    out = out.when((F.col("type") == "tap") & (reps > 0), taps)
    e = s.select("macro_id", "seq", F.posexplode(out).alias("pos", "e"))
    return e.select("macro_id", "seq", "pos", F.bround("e.t", 1).alias("t"), "e.type", "e.id", "e.val", "e.hx", "e.hy")


def decode_events(events: DataFrame) -> DataFrame:
    """Steps of timed events(macro_id, seq, t, type, id, val, hx, hy): a wait for each positive gap rounded half to even,
    then the action. Remainders aren't carried on."""
    gap = F.bround(_or("t", 0.0) - F.lag(_or("t", 0.0), 1, 0.0).over(Window.partitionBy("macro_id").orderBy("seq")), 0)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    step = lambda kind, delay, direction, btn: F.struct(kind.alias("type"), delay.alias("delay"), direction.alias("dir"), btn.alias("btn"))
    press = step(F.when(F.col("val") != 0, "press").otherwise("release"), number, text, L.button_name(F.col("id")))
    turn = step(F.lit("dir"), number, L.direction_name(F.col("hx"), F.col("hy")), text)
    both = F.array(F.when(F.col("_d") > 0, step(F.lit("wait"), F.col("_d"), text, text)), F.when(F.col("type") == "btn", press).when(F.col("type") == "hat", turn))
    e = events.withColumn("_d", gap).select("macro_id", "seq", F.posexplode(both).alias("pos", "s")).where("s IS NOT NULL")
    return e.select("macro_id", "seq", "pos", "s.type", "s.delay", "s.dir", "s.btn")


def normalize_steps(steps: DataFrame) -> DataFrame:
    """Delays cut to whole numbers; waits of none or less go; an action with a delay becomes a wait and the action."""
    s = steps.withColumn("type", _or("type", "wait")).withColumn("_d", _or("delay", 0.0).cast("int").cast("double"))
    names = [c for c in s.columns if c not in ("macro_id", "seq", "_d")]
    wait = F.struct(*[(F.lit("wait") if c == "type" else F.col("_d") if c == "delay" else F.lit(None).cast(s.schema[c].dataType)).alias(c) for c in names])
    action = F.struct(*[(F.lit(None).cast("double") if c == "delay" else F.col(c)).alias(c) for c in names])
    both = F.array(F.when(F.col("_d") > 0, wait), F.when(F.col("type") != "wait", action))
    return s.select("macro_id", "seq", F.posexplode(both).alias("pos", "s")).where("s IS NOT NULL").select("macro_id", "seq", "pos", *[f"s.{c}" for c in names])


def _label() -> Column:
    """What a step is shown as, without its place. A step without a type is shown as such, not as a wait."""
    btn, direction = _or("btn", "A"), _or("dir", NEUTRAL)
    # The words of the labels, here and in toggle_comments().
    text = F.when(F.col("type") == "wait", F.concat(F.lit("延迟 "), F.bround(_or("delay", 0.0), 0).cast("bigint").cast("string"), F.lit("ms")))
    text = text.when(F.col("type") == "press", F.concat(F.lit("按下 "), btn)).when(F.col("type") == "release", F.concat(F.lit("松开 "), btn)).when(F.col("type") == "dir", F.concat(F.lit("方向 "), direction))
    tap = F.format_string("连按 %s ×%d  (%d/%dms)", btn, *[_or(c, v) for c, v in TAP.items()])
    return text.when(F.col("type") == "tap", tap).when(F.col("type") == "comment", F.concat(F.lit("// "), _or("text", ""))).otherwise(_or("type", "?"))


def display(steps: DataFrame) -> DataFrame:
    """steps with the column label; numbers are places within the macro, from 1."""
    place = F.format_string("%3d.  ", F.row_number().over(Window.partitionBy("macro_id").orderBy("seq")))
    shown = steps.withColumns({c: _or(c, v) for c, v in TAP.items()})
    return _filled(shown.withColumn("label", F.concat(place, _label())))


def toggle_comments(steps: DataFrame, chosen: Column) -> DataFrame:
    """Chosen steps become comments that keep the step in disabled_step; comments that keep one become it again; other
    chosen comments go. Places are not renumbered. Local to a row, no exchange."""
    names = [c.split()[0] for c in STEP.split(", ")]
    kept = F.col("disabled_step") if "disabled_step" in steps.columns else F.lit(None)
    s = steps.withColumn("disabled_step", kept.cast(f"struct<{STEP}>")).withColumn("_on", F.coalesce(chosen, F.lit(False)))
    comment, holds = F.coalesce(F.col("type") == "comment", F.lit(False)), F.col("disabled_step").isNotNull()
    s = s.where(~(F.col("_on") & comment & ~holds))
    note = F.concat(F.lit("(被注释) "), F.regexp_replace(_label(), r"^\s+|\s+$", ""))
    fresh = {"type": F.lit("comment"), "text": note}
    values = {c: F.when(~F.col("_on"), F.col(c)).when(comment, F.col(f"disabled_step.{c}")).otherwise(fresh.get(c, F.lit(None))) for c in names}
    values["disabled_step"] = F.when(~F.col("_on"), F.col("disabled_step")).when(~comment, F.struct(*names))
    return s.withColumns(values).drop("_on")


def sizes(steps: DataFrame, kind: Column) -> DataFrame:
    """(macro_id, n_steps, n_waits) of steps, or of events as steps; kind: the step's type."""
    return steps.groupBy("macro_id").agg(F.count("*").alias("n_steps"), F.count_if(kind == "wait").alias("n_waits"))


def clamped(values: dict[str, Column]) -> dict[str, Column]:
    """Edited numbers brought into range: delay and gap from 0, rep and dur from 1."""
    least = {"delay": 0, "gap": 0, "rep": 1, "dur": 1}
    return {c: F.greatest(v, F.lit(least[c])) for c, v in values.items()}


def tap_times(rep: Column, dur: Column, gap: Column) -> Column:
    """(rep, press_at, release_at) of each repetition of a tap, from its start; none for rep of 0 or less or null."""
    at = lambda r: F.struct(r.alias("rep"), (r * (dur + gap)).cast("bigint").alias("press_at"), (r * (dur + gap) + dur).cast("bigint").alias("release_at"))
    return F.when(rep > 0, F.transform(F.sequence(F.lit(0), rep - 1), at))


def replay_events(steps: DataFrame, events: DataFrame, mirror: bool = False) -> DataFrame:
    """What a macro plays: its compiled steps where it has any, else its stored events, mirrored if asked for."""
    from_steps = compile_steps(steps, mirror)
    rest = events.join(steps.select("macro_id").distinct(), "macro_id", "left_anti")
    if mirror:
        rest = rest.withColumn("hx", F.when(F.col("type") == "hat", L.mirror_x(F.col("hx"), F.col("hy"))).otherwise(F.col("hx")))
    return from_steps.unionByName(rest.withColumn("pos", F.lit(0)).select(*from_steps.columns))
