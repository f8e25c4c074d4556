"""Nested JSON documents: profiles, configuration, macro files, templates; reading with defaults and fallbacks, writing.

A document is either one JSON value over any number of lines, or JSON lines as write_json() leaves them; readers tell
which by the first line that isn't blank.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.steps import decode_events, normalize_steps
from ..schemas import CONFIG, MACRO, PROFILE, STEP, STEP_FULL


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a document that isn't blank; None where there is none, or no document."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(files):
        return None
    row = spark.read.text(path).where(F.trim("value") != "").first()
    return row and row["value"].strip()


def _is_line(line: str) -> bool:
    """Whether the line is a whole JSON object, so that the document is JSON lines."""
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    line = first_line(spark, path)
    return spark.read.schema(schema).option("multiLine", line is None or not _is_line(line)).json(path)


def read_profiles(spark: SparkSession, path: str, legacy: str | None = None, macros: str | None = None) -> DataFrame:
    """Profiles of the document at path; where it has none or isn't there, the field `profiles` of the configuration at
    legacy; where that has none, one default profile with the macros of the document at `macros`, if any."""
    if first_line(spark, path) is not None:
        found = _documents(spark, path, PROFILE).where("name IS NOT NULL OR macros IS NOT NULL")
        if found.limit(1).count():
            return found
    if legacy and first_line(spark, legacy) is not None:
        found = spark.read.schema(f"profiles ARRAY<STRUCT<{PROFILE}>>").option("multiLine", True).json(legacy).select(F.explode("profiles").alias("p")).select("p.*")
        if found.limit(1).count():
            return found
    # Fixed value: the default profile's name.
    one = spark.range(1).select(F.lit("全局默认").alias("name"), F.lit(-1).alias("trigger_btn"), F.lit(-1).alias("trigger_macro_idx"), F.create_map().cast("map<string,int>").alias("hotkey_binds"))
    if macros and (first_line(spark, macros) or "").startswith("["):
        held = read_macros(spark, macros).agg(F.collect_list(F.struct("name", "events", "steps")).alias("macros"))  # one document's macros
    else:
        held = spark.range(1).select(F.from_json(F.lit("[]"), f"ARRAY<STRUCT<{MACRO}>>").alias("macros"))
    return one.join(held)  # one row each


def read_config(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """One row; missing fields get their defaults. The button map's keys become integers. Of no document all are defaults."""
    if first_line(spark, path) is None:
        df = spark.range(1).select(F.from_json(F.lit("{}"), CONFIG).alias("c")).select("c.*")
    else:
        df = _documents(spark, path, CONFIG)
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})
    return df.withColumn("btn_map", F.transform_keys("btn_map", lambda k, _: k.try_cast("int")))


def read_macros(spark: SparkSession, path: str) -> DataFrame:
    """A macro file, whose top level must be a list; JSON lines count as one."""
    line = first_line(spark, path)
    if line is None or not line.startswith("[") and not (_is_line(line) and spark.read.text(path).where(F.trim("value") != "").limit(2).count() > 1):
        raise ValueError(f"{path} holds no list of macros")
    return _documents(spark, path, MACRO)


def import_macros(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """macros(macro_id, name) and steps(macro_id, seq, pos, ...) of a macro file, to replace all that were there: steps are
    normalised, or where a macro has none decoded from its events. macro_id is the macro's place, as names may repeat."""
    order = Window.orderBy(F.monotonically_increasing_id())  # one document's macros
    macros = read_macros(spark, path).withColumn("macro_id", (F.row_number().over(order) - 1).cast("string"))
    named = macros.drop("name").withColumnRenamed("macro_id", "name")
    own = F.size(F.coalesce("steps", F.array())) > 0
    steps = normalize_steps(macro_steps(named.where(own)).drop("disabled_step"))
    return macros.select("macro_id", "name"), steps.unionByName(decode_events(macro_events(named.where(~own))), allowMissingColumns=True)


def event_columns(val: Column) -> dict[str, Column]:
    """The union of a button's number and a hat's pair, in columns of their own."""
    pair = F.try_variant_get(val, "$", "array<int>")
    return {"val": F.try_variant_get(val, "$", "int"), "hx": F.try_element_at(pair, F.lit(1)), "hy": F.try_element_at(pair, F.lit(2))}


def macro_steps(macros: DataFrame) -> DataFrame:
    """steps(macro_id, seq, ...) of macros(name, steps)."""
    return macros.select(F.col("name").alias("macro_id"), F.posexplode("steps").alias("seq", "s")).select("macro_id", F.col("seq").cast("bigint").alias("seq"), "s.*")


def macro_events(macros: DataFrame) -> DataFrame:
    """events(macro_id, seq, t, type, id, val, hx, hy) of macros(name, events)."""
    e = macros.select(F.col("name").alias("macro_id"), F.posexplode("events").alias("seq", "e"))
    return e.select("macro_id", F.col("seq").cast("bigint").alias("seq"), "e.t", "e.type", "e.id", *[c.alias(n) for n, c in event_columns(F.col("e.val")).items()])


def steps_from_text(text: Column) -> Column:
    """Edited JSON text as an array of steps: blank is empty, anything but a list is null."""
    parsed = F.from_json(text, f"ARRAY<STRUCT<{STEP_FULL}>>")
    is_list = F.ltrim(text).startswith("[")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.from_json(F.lit("[]"), f"ARRAY<STRUCT<{STEP_FULL}>>")).when(is_list, parsed)


def step_text(step: Column) -> Column:
    """A step, or an array of steps, as JSON text: fields that are null are left out, all letters stay as they are."""
    return F.to_json(step)


def template_steps(text: Column) -> Column:
    """The steps of a template as JSON text. Besides steps it may hold items of the old form [kind, argument], of which those of
    an unknown kind are skipped. Blank text, or anything but a list, has none."""
    names = [c.split()[0] for c in STEP.split(", ")]
    kinds = dict(c.split() for c in STEP.split(", "))

    def step(item: Column) -> Column:
        kind = F.try_variant_get(item, "$[0]", "string")
        # Kinds of the old form, with the field of their argument.
        own = {"delay": ["wait"], "dir": ["dir"], "btn": ["press", "release"]}
        old = {c: F.when(kind.isin(k), F.try_variant_get(item, "$[1]", kinds[c])) for c, k in own.items()} | {"type": kind}
        legacy = F.struct(*[old.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in names])
        plain = F.struct(*[F.try_variant_get(item, f"$.{c}", kinds[c]).alias(c) for c in names])
        is_list = F.schema_of_variant(item).startswith("ARRAY")
        return F.when(is_list & kind.isin([k for ks in own.values() for k in ks]), legacy).when(~is_list, plain)

    items = F.try_variant_get(F.try_parse_json(F.when(F.ltrim(text).startswith("["), text)), "$", "array<variant>")
    items = F.coalesce(items, F.array().cast("array<variant>"))
    return F.filter(F.transform(items, step), lambda s: s.isNotNull())


def field(document: Column, path: str, kind: str) -> Column:
    """One field of a JSON text, null where it is missing or of another kind."""
    return F.get_json_object(document, path).try_cast(kind)


def write_json(df: DataFrame, path: str) -> None:
    """Replaces what is at path by JSON lines, which the readers here read back. They are written beside it first, so df may
    come from path itself, and a write that fails leaves the old document."""
    spark, new = df.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.json(new)
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(to_path(path), True)
    if not files.rename(to_path(new), to_path(path)):
        raise OSError(f"{new} could not be renamed to {path}")
