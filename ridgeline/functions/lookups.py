"""Lookups with a default: directions, their mirror images, buttons. Small literal maps, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BUTTONS, DIRECTIONS, NEUTRAL

NAME_OF = {v: k for k, v in DIRECTIONS.items()}


def literal_map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in items.items() for x in kv])


def lookup(items: dict, key: Column, default: Column) -> Column:
    """items[key], or default where key is null or missing."""
    return F.coalesce(F.try_element_at(literal_map(items), key), default) if items else default


def mirror_name(name: Column) -> Column:
    """The direction with left and right swapped; a name that is none stays."""
    return lookup({k: NAME_OF[-x, y] for k, (x, y) in DIRECTIONS.items()}, name, name)


def mirror_x(hx: Column, hy: Column) -> Column:
    """The x of the mirrored vector; vectors that are no direction stay."""
    return F.when(hx.between(-1, 1) & hy.between(-1, 1), -hx).otherwise(hx)


def direction_x(name: Column) -> Column:
    return lookup({k: v[0] for k, v in DIRECTIONS.items()}, name, F.lit(0))


def direction_y(name: Column) -> Column:
    return lookup({k: v[1] for k, v in DIRECTIONS.items()}, name, F.lit(0))


def direction_name(hx: Column, hy: Column) -> Column:
    """The direction of a vector, neutral for all others."""
    return lookup({f"{x},{y}": k for k, (x, y) in DIRECTIONS.items()}, F.concat_ws(",", hx, hy), F.lit(NEUTRAL))


def button_id(name: Column) -> Column:
    """The button's id by name, in any case and with white space around; else the integer it spells; else 0."""
    plain = F.upper(F.regexp_replace(name, r"^\s+|\s+$", ""))
    digits = F.when(plain.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(plain, "_", "")).try_cast("int")
    return F.coalesce(F.try_element_at(literal_map({b.upper(): i for i, b in enumerate(BUTTONS)}), plain), digits, F.lit(0))


def button_name(button: Column) -> Column:
    return lookup(dict(enumerate(BUTTONS)), button, F.concat(F.lit("BTN"), button.cast("string")))


def button_ids(combination: Column) -> Column:
    """The ids of a combination as A+B, in order."""
    return F.transform(F.split(combination, "[+]"), button_id)


def process_name(name: Column) -> Column:
    """A process's name as it is compared: lower-cased, with .exe at its end."""
    plain = F.lower(name)
    return F.when(plain.endswith(".exe"), plain).otherwise(F.concat(plain, F.lit(".exe")))


def shown_title(title: Column, part: str, visible: Column | None = None) -> Column:
    """Whether a visible window's title is not empty and holds part, in the same case."""
    return (F.lit(True) if visible is None else F.coalesce(visible, F.lit(False))) & F.coalesce((title != "") & title.contains(part), F.lit(False))
