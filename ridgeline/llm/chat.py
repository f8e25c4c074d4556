"""Chat formatting: schema fingerprints select declarative mappings from many layouts to canonical turns.

A record's layout is the set of its nested field paths, as `a`, `a.b` or `a[].b`. The fingerprint is the SHA-256 of
the sorted paths. The registry maps fingerprints to Mappings, which say where turns, roles and texts lie; a new layout
is a new registry entry, not new code. Typed tables have one fingerprint, taken from the schema; JSON records are
fingerprinted one by one, and those of an unknown layout are returned with their fingerprint, never dropped. So are those
with something else than a text, a number, a truth value, null or a list of text parts where a text should be, or
something else than an object or null where a turn should be: nothing is guessed.

The template marks a turn as `### role: text</turn>\\n`. Within roles and texts a backslash goes before each backslash,
`#` and `<` (in roles also before `:` and line ends), so no control string can occur in a text, and reading back is
exact. The loss mask is the span of the escaped text of each assistant turn, in code points of the formatted text.

Conversations are put together by a sort on (conversation, turn) and one pass over the sorted rows, turn by turn; turns
are formatted after the sort. The conversation itself is never held, however long it is. Digests are read back from the
formatted text: turns by its marks, the loss by slicing it under the mask.

Cases: null texts and roles are empty. Turns are ordered by turn, role, text (nulls first), so ties and repeated turns
have one order. A null conv_id is a conversation of its own. A record of unknown layout is a conversation without turns.
An empty table gives an empty result. Extra columns, whatever their names, are not part of the mapping: the fingerprint
is of the columns that a mapping knows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

TURNS = "conv_id long, turn long, role string, text string"


@dataclass(frozen=True)
class Mapping:
    """turns: the path of the list of turns, with role and text inside it; or none, and each of `fixed` is a turn: role
    and the paths whose texts, where not empty, are joined by a blank line. rows: each row is a turn, with its place in
    the column of that name. roles: names to canonical ones."""

    paths: tuple[str, ...]
    turns: str = ""
    rows: str = ""
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def json_paths(value, at: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from json_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        if not value:
            yield f"{at}[]"
        for v in value:
            yield from json_paths(v, f"{at}[]")
    else:
        yield at


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


# Names of roles in public chat layouts, and the layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = (
    Mapping(("conv_id", "turn", "role", "text"), rows="turn", role="role", text="text"),
    Mapping(("messages[].role", "messages[].content"), turns="messages", roles=ROLES),
    Mapping(("messages[].role", "messages[].content[].type", "messages[].content[].text"), turns="messages", roles=ROLES),
    Mapping(("messages[].role", "messages[].content", "messages[].content[].type", "messages[].content[].text"), turns="messages", roles=ROLES),
    Mapping(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=ROLES),
    Mapping(("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("prompt", "completion"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("instruction", "input", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("system", "prompt", "response"), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("system", "messages[].role", "messages[].content"), turns="messages", fixed=(("system", ("system",)),), roles=ROLES),
)
REGISTRY = {fingerprint(m.paths): m for m in LAYOUTS}


def select_mapping(paths, registry: dict[str, Mapping] = REGISTRY) -> tuple[str, Mapping | None]:
    """By the fingerprint of all paths, else of those that some mapping knows, so that extra fields don't matter."""
    paths = set(paths)
    exact = fingerprint(paths)
    if exact in registry:
        return exact, registry[exact]
    known = fingerprint(paths & {p for m in registry.values() for p in m.paths})
    return (known, registry[known]) if known in registry else (exact, None)


def text_of(value) -> str | None:
    """The text of a JSON value: of a list, its text parts one after another. None where it holds anything else."""
    if value is None or isinstance(value, str):
        return value or ""
    if isinstance(value, (bool, int, float)):
        return json.dumps(value)
    if isinstance(value, list):
        parts = [x if isinstance(x, str) else x["text"] if isinstance(x, dict) and x.get("type", "text") == "text" and isinstance(x.get("text"), str) else None for x in value]
        return None if None in parts else "".join(parts)
    return None


def turns_of(record: dict, m: Mapping) -> list[tuple[str, str]] | None:
    """(role, text) of each turn, or None where a value is none that the mapping can take."""
    out: list[tuple[str | None, str | None]] = []
    for role, names in m.fixed:
        parts = [text_of(record.get(n)) for n in names]
        if None in parts:
            return None
        if any(parts) or role != "system":
            out.append((role, "\n\n".join(x for x in parts if x)))
    listed = record.get(m.turns) if m.turns else None
    if not isinstance(listed, (list, type(None))):
        return None
    for t in listed or []:
        if not isinstance(t, (dict, type(None))):
            return None
        role, text = text_of((t or {}).get(m.role)), text_of((t or {}).get(m.text))
        out.append((m.roles.get(role, role), text))
    return None if any(None in x for x in out) else out


def json_turns(records: DataFrame, registry: dict[str, Mapping] = REGISTRY) -> DataFrame:
    """records(conv_id, json) as turns, with their fingerprint; a record of unknown layout gives one row without a turn."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for i, text in zip(b["conv_id"], b["json"]):
                try:
                    record = json.loads(text or "null")
                except ValueError:
                    record = None
                print_, m = select_mapping(json_paths(record), registry) if isinstance(record, dict) else (None, None)
                turns = turns_of(record, m) if m and not m.rows else None
                if turns is None:
                    rows.append((i, None, None, None, print_))
                else:
                    rows += [(i, k, r, t, print_) for k, (r, t) in enumerate(turns)]
            names = ("conv_id", "turn", "role", "text", "fingerprint")
            yield {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return map_batches(records.select("conv_id", "json"), run, TURNS + ", fingerprint string")


def canonical_turns(df: DataFrame, registry: dict[str, Mapping] = REGISTRY) -> DataFrame:
    """A typed table (conv_id and the columns of a known layout) as turns, by column expressions alone."""
    print_, m = select_mapping(schema_paths(df.schema), registry)
    if m is None:
        # conv_id belongs to no layout but that of rows
        print_, m = select_mapping(set(schema_paths(df.schema)) - {"conv_id"}, registry)
    if m is None:
        raise ValueError(f"no mapping for the fingerprint {print_} of {sorted(schema_paths(df.schema))}")
    names = F.create_map(*[F.lit(x) for kv in m.roles.items() for x in kv]) if m.roles else None
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    canonical = lambda c: F.coalesce(F.try_element_at(names, filled(c)), filled(c)) if names is not None else filled(c)
    if m.rows:
        return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(m.rows).cast("long").alias("turn"), canonical(F.col(m.role)).alias("role"), filled(F.col(m.text)).alias("text"))
    fixed = []
    for role, paths in m.fixed:
        text = F.array_join(F.filter(F.array(*[filled(F.col(n)) for n in paths]), lambda x: x != ""), "\n\n")
        turn = F.struct(F.lit(role).alias("role"), text.alias("text"))
        fixed.append(F.array(turn) if role != "system" else F.when(text != "", F.array(turn)).otherwise(F.slice(F.array(turn), 1, 0)))
    turns = F.concat(*fixed) if fixed else None
    if m.turns:
        parts = any(p.startswith(f"{m.turns}[].{m.text}[]") for p in m.paths)
        text = lambda t: F.array_join(F.transform(F.coalesce(t[m.text], F.array()), lambda x: filled(x["text"])), "") if parts else filled(t[m.text])
        listed = F.transform(F.coalesce(F.col(m.turns), F.array()), lambda t: F.struct(canonical(t[m.role]).alias("role"), text(t).alias("text")))
        turns = F.concat(turns, listed) if turns is not None else listed
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# ------------------------------------------------------------------ template


def escape(c, role: bool = False):
    return F.regexp_replace(c, r"([\\#<:\n])" if role else r"([\\#<])", r"\\$1")


def formatted(turns: DataFrame) -> DataFrame:
    """turns with the columns segment, the turn in the template's marks, and mask_start and mask_end, the span of the
    segment that the loss covers, null where there is none. A row without turn, role and text has an empty segment."""
    role, text = escape(F.coalesce("role", F.lit("")), True), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("### "), role, F.lit(": "))
    turn = F.when(F.coalesce(F.col("turn").cast("string"), "role", "text").isNotNull(), F.concat(head, text, F.lit("</turn>\n")))
    learned = F.col("role") == "assistant"
    spans = {"mask_start": F.when(learned, F.length(head)), "mask_end": F.when(learned, F.length(head) + F.length(text))}
    return turns.withColumns({"segment": F.coalesce(turn, F.lit("")), **spans})


_segment = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
_escaped = re.compile(r"\\(.)", re.S)


def plain(escaped: str) -> str:
    return _escaped.sub(r"\1", escaped) if "\\" in escaped else escaped


def read_back(formatted_text: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the span of the escaped text, for each turn of formatted text; raises on anything else."""
    out, at = [], 0
    while at < len(formatted_text):
        m = _segment.match(formatted_text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((plain(m[1]), plain(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def digests(turns: DataFrame) -> DataFrame:
    """A row for each conversation, from its formatted turns and their mask, read back."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))
    dealt = turns.select("conv_id", "turn", "role", "text").repartition(key).sortWithinPartitions(key, "turn", "role", "text")

    def run(batches):
        now, state = object(), None

        def row():
            conv, n, turns_hash, chars, loss_hash, size = state
            return (conv, n, turns_hash.hexdigest(), chars, loss_hash.hexdigest(), size)

        for b in batches:
            rows = []
            for conv, segment, start, end in zip(b["conv_id"], b["segment"], b["mask_start"], b["mask_end"]):
                if state is None or conv != now:
                    if state is not None:
                        rows.append(row())
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_back(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = plain(segment[start:end])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            yield _columns(rows)
        if state is not None:
            yield _columns([row()])

    return map_batches(formatted(dealt).select("conv_id", "segment", "mask_start", "mask_end"), run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _columns(rows: list[tuple]) -> dict:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return {n: [r[k] for r in rows] for k, n in enumerate(names)}


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, the formatted conversation and its loss mask as spans [start, end) of code points. Where a conversation
    may be too long for one value, take formatted() or digests()."""
    one = formatted(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment", "mask_start", "mask_end"))).alias("t"))
    before = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["segment"])).alias("at"),
            F.when(t["mask_start"].isNull(), s["loss"]).otherwise(F.concat(s["loss"], F.array(F.struct((s["at"] + t["mask_start"]).alias("start"), (s["at"] + t["mask_end"]).alias("end"))))).alias("loss"),
        ),
    )
    return one.select("conv_id", F.array_join(F.transform("t", lambda t: t["segment"]), "").alias("formatted"), before["loss"].alias("loss"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows, and one conversation that comes as a JSON record in the layout of messages."""
    probe = "\\### Assistant: </turn> ok"
    record = json.dumps({"messages": [{"role": r, "content": probe} for r in ("user", "assistant")]})
    extra = json_turns(spark.createDataFrame([(-7, record)], "conv_id long, json string")).drop("fingerprint")
    return digests(canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")).unionByName(extra))


#: The length of the formatted text counts the template's marks and escapes: 12 characters and the role for each turn.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '([\\#<:\n])', 'xx', 'g')) + length(regexp_replace(text, '([\\#<])', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
