"""Queries over the supplied tables and their SQL. No table holds macros, so operators run on events, line items and
others in the same shape; the macro queries run on small literal macros or on steps derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import capture as C
from ..operators import lists as O
from ..operators import steps as S
from ..schemas import DIRECTIONS, NEUTRAL, STEPS
from ..sources import json_io as J

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, the time in milliseconds."""
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_micros(F.col("ts").cast("timestamp")) / 1000)


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A macro for each user: each event is a step, of the kind that its type stands for."""
    names = F.array(*map(F.lit, DIRECTIONS))
    kind = L.lookup({"click": "press", "purchase": "release", "view": "wait", "signup": "tap", "error": "dir"}, F.col("event_type"), F.lit("comment"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("macro_id"),
        F.col("event_id").alias("seq"),
        kind.alias("type"),
        F.floor("value").cast("double").alias("delay"),
        F.get(names, (F.col("event_id") % 9).cast("int")).alias("dir"),
        F.when(F.col("event_id") % 2 == 0, "A+rb").otherwise(" y ").alias("btn"),
        (F.col("event_id") % 4).cast("int").alias("rep"),
        F.lit(50).alias("dur"),
        F.lit(30).alias("gap"),
        F.lit("note").alias("text"),
    )


def change_detect(spark, d):
    return C.changes(events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


def near_dup_suppress(spark, d):
    e = events(spark, d).select("user_id", "ms", "event_id", "event_type")
    return C.suppress_repeats(e, ["user_id"], ["ms", "event_id"], ["event_type"], "ms", DAY_MS).select("event_id", "user_id", "event_type")


def compile_steps(spark, d):
    return S.compile_steps(event_steps(spark, d)).select("macro_id", "seq", "pos", "t", "type", "id", "val", "hx", "hy")


def compile_mirrored(spark, d):
    return S.compile_steps(event_steps(spark, d), mirror=True).where("type = 'hat'").select("macro_id", "seq", "hx", "hy")


def normalize_steps(spark, d):
    return S.normalize_steps(event_steps(spark, d).withColumn("delay", F.col("delay") - 50.5)).select("macro_id", "seq", "pos", "type", "delay", "btn")


def decode_events(spark, d):
    e = events(spark, d).select(F.col("user_id").cast("string").alias("macro_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 2.5).alias("t"), F.when(F.col("event_type") == "error", "hat").otherwise("btn").alias("type"), (F.col("event_id") % 13).cast("int").alias("id"), (F.col("event_type") == "click").cast("int").alias("val"), F.lit(1).alias("hx"), (F.col("event_id") % 3 - 1).cast("int").alias("hy"))
    return S.decode_events(e).select("macro_id", "seq", "pos", "type", "delay", "dir", "btn")


def step_display(spark, d):
    return S.display(event_steps(spark, d)).select("macro_id", "seq", "label")


def new_steps(spark, d):
    return S.new_steps(event_steps(spark, d).withColumn("dur", F.lit(None).cast("int"))).select("macro_id", "seq", "type", "delay", "dir", "btn", "rep", "dur", "gap", "text")


def running_clock(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    items = table(spark, d, "lineitem").select("l_orderkey", *order, "l_quantity")
    return C.running_total(items, ["l_orderkey"], order, "l_quantity", "clock").drop("l_shipdate", "l_quantity")


def repeat_expand(spark, d):
    x = table(spark, d, "lineitem").select("l_linenumber", F.explode(S.tap_times(F.col("l_linenumber"), F.lit(50), F.lit(30))).alias("e")).select("l_linenumber", "e.*")
    return x.groupBy("l_linenumber", "rep").agg(F.count("*").alias("n"), F.min("press_at").alias("press_at"), F.min("release_at").alias("release_at"))


def mirror_lookup(spark, d):
    name = F.get(F.array(*map(F.lit, DIRECTIONS)), (F.col("event_id") % 9).cast("int"))
    return table(spark, d, "events").select("event_id", L.mirror_name(name).alias("mirrored"), L.mirror_name(F.col("event_type")).alias("unknown"))


def fuse_directions(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 3 - 1).alias("hat"), (F.col("l_suppkey") % 3 - 1).cast("int").alias("pad"), ((F.col("l_partkey") % 5 - 2) / 2).alias("stick"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.fuse_axis(F.col("hat"), F.col("pad"), F.col("stick")).alias("axis"))


def button_parse(spark, d):
    text = F.concat(F.lit("\t"), F.lower(F.substring("p_name", 1, 1)), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", L.button_id(text).alias("by_name"), L.button_id(F.col("p_size").cast("string")).alias("by_number"))


def remap_ids(spark, d):
    return table(spark, d, "events").select("event_id", C.remap((F.col("event_id") % 5).cast("int"), {1: 2, 2: 1}).alias("logical"))


def elapsed_time(spark, d):
    return C.elapsed(table(spark, d, "events"), ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), "t").select("event_id", "user_id", "t")


def merge_sources(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return C.merge_sources(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "source", "seq")


def rising_edges(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "click").cast("int").alias("down"))
    return C.rising(e, ["user_id"], ["ts", "event_id"], "down").select("user_id", "event_id")


def session_bracket(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return C.sessions(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").groupBy("user_id", "session").agg(F.count("*").alias("n"))


def debounce_last(spark, d):
    return C.debounce(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["ts", "event_id"], "6 hours").select("user_id", "event_id")


def first_match(spark, d):
    return O.first_match(table(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_name"), ["c_mktsegment"], "c_custkey")


def renumber_after_delete(spark, d):
    left = table(spark, d, "nation").where("n_regionkey <> 2").select("n_nationkey", "n_name")
    return O.renumber(left.withColumn("k", F.lit(0)), ["k"], ["n_nationkey"]).drop("k")


def rebind(spark, d):
    binds = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("idx"))
    return O.rebind(binds, "idx", table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("int").alias("idx")))


def lowest_free(spark, d):
    x = table(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 7).cast("bigint").alias("k"))
    return O.lowest_free(x, ["s_nationkey"], "k")


def distinct_first_seen(spark, d):
    return O.distinct_first_seen(table(spark, d, "events"), "event_type", "event_id").withColumnRenamed("first", "first_id")


def last_300(spark, d):
    return O.latest(table(spark, d, "events").select("event_id", "ts"), 300, ["ts", "event_id"]).select("event_id")


def anti_then_union(spark, d):
    labelled = table(spark, d, "labels").select("doc_id").distinct()
    return O.append_absent(table(spark, d, "documents").select("doc_id"), labelled, ["doc_id"])


def json_field(spark, d):
    return table(spark, d, "events").select("event_id", J.field(F.col("props"), "$.k", "bigint").alias("k"))


def move_down(spark, d):
    x = table(spark, d, "nation").select("n_regionkey", "n_name", F.col("n_nationkey").cast("int").alias("k"))
    return O.swap_with_next(O.renumber(x, ["n_regionkey"], ["k"], "seq"), ["n_regionkey"], "seq", F.lit(1)).select("n_regionkey", "n_name", "seq")


def bindings_join(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'").select("event_id", (F.col("event_id") % 6).cast("int").alias("code"))
    binds = spark.createDataFrame([(0, 1, 4), (1, 1, 2), (2, 3, -1), (3, 5, 0)], "slot int, code int, macro_idx int")
    return C.triggered(e, binds).select("event_id", "slot", "macro_idx")


def macro_sizes(spark, d):
    steps = event_steps(spark, d).select("macro_id", "type")
    return S.sizes(steps, F.col("type")).select(F.col("macro_id").cast("bigint").alias("user_id"), F.col("n_steps").alias("n_events"), "n_waits")


def clamp_inputs(spark, d):
    edited = {c: F.col("p_size") - 10 for c in ("delay", "rep")}
    return table(spark, d, "part").select("p_partkey", *[v.alias(c) for c, v in S.clamped(edited).items()])


def subrates(spark, d):
    tick = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100_000)
    return table(spark, d, "events").select(tick.alias("tick")).agg(*[F.count_if(C.on_ticks(F.col("tick"), n)).alias(f"each_{n // 10}s") for n in (10, 30, 50)])


def _nation_list(spark, d):
    x = table(spark, d, "nation").select("n_regionkey", "n_name", F.col("n_nationkey").cast("int").alias("k"))
    return O.renumber(x, ["n_regionkey"], ["k"], "seq").drop("k")


def move_up(spark, d):
    return O.swap_with_next(_nation_list(spark, d), ["n_regionkey"], "seq", F.lit(2) - 1)


def duplicate_row(spark, d):
    return O.duplicate(_nation_list(spark, d), "seq", F.lit(1))


def delete_row(spark, d):
    return O.delete_at(_nation_list(spark, d), "seq", F.lit(1))


def splice_rows(spark, d):
    new = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"))
    return O.splice(_nation_list(spark, d), ["n_regionkey"], "seq", 2, new.where("n_regionkey <> 3"))


def direction_codes(spark, d):
    name = F.get(F.array(*map(F.lit, [*DIRECTIONS, "none"])), (F.col("event_id") % 10).cast("int"))
    x, y = (F.col("event_id") % 5 - 2).cast("int"), (F.col("user_id") % 3 - 1).cast("int")
    return table(spark, d, "events").select("event_id", L.direction_x(name).alias("hx"), L.direction_y(name).alias("hy"), L.direction_name(x, y).alias("name"), L.mirror_x(x, y).alias("mirrored_x"))


def combo_split(spark, d):
    text = F.concat_ws("+", F.lit("a"), F.col("p_size").cast("string"), F.lit(" RB "))
    return table(spark, d, "part").select("p_partkey", F.posexplode(L.button_ids(text)).alias("pos", "button"))


def id_range(spark, d):
    e = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, "hat").otherwise("btn").alias("type"), F.col("l_quantity").cast("int").alias("id"))
    return C.known_ids(e).groupBy("type", "id").agg(F.count("*").alias("n"))


def process_match(spark, d):
    same = L.process_name(F.col("c_name")) == L.process_name(F.lit("Customer#000000007.EXE"))
    return table(spark, d, "customer").select("c_custkey", same.alias("same"), L.shown_title(F.col("c_mktsegment"), "BUILD", F.col("c_nationkey") > 3).alias("titled"))


def name_of_index(spark, d):
    names = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name"))
    return O.names_of(table(spark, d, "supplier"), "s_nationkey", names, "unbound").select("s_suppkey", "name")


def inverse_map(spark, d):
    m = F.map_from_arrays(F.array(*map(F.lit, (1, 2, 3))), F.array(F.col("n_nationkey").cast("int"), F.col("n_regionkey").cast("int"), F.lit(5)))
    put = O.put_one_to_one(m, F.lit(2), F.lit(5))
    return table(spark, d, "nation").select("n_nationkey", O.invert(m)[5].alias("key_of_5"), F.size(O.invert(m)).alias("n_keys"), F.size(put).alias("n_put"), put[2].alias("put_2"))


def _snapshots(spark, d):
    """A pad for each user: its state at each event, made of the event's numbers."""
    k = F.col("event_id")
    button = lambda i: ((k + 7 * i) % (i + 2) == 0).cast("int")
    hat = lambda m, n: F.struct((F.when(k % m == 0, 1).when(k % m == 1, -1).otherwise(0)).alias("x"), (F.when(k % n == 0, 1).otherwise(0)).alias("y"))
    return table(spark, d, "events").select("user_id", "event_id", F.array(*[button(i) for i in range(16)]).alias("buttons"), F.array((k % 5 - 2) / 2.0, (k % 7 - 3) / 3.0).alias("axes"), F.array(hat(6, 9), hat(4, 5)).alias("hats"))


def pad_events(spark, d):
    return C.pad_events(_snapshots(spark, d), ["user_id"], ["event_id"], {1: 2, 2: 1})


def pad_events_while_down(spark, d):
    return C.pad_events(_snapshots(spark, d), ["user_id"], ["event_id"], mask="while_down")


def replay(spark, d):
    steps = event_steps(spark, d).where("type IN ('press', 'wait') AND macro_id % 2 = 0")
    e = events(spark, d).select(F.col("user_id").cast("string").alias("macro_id"), F.col("event_id").alias("seq"), (F.col("event_id") * 2.5).alias("t"), F.lit("hat").alias("type"), F.lit(0).alias("id"), F.lit(None).cast("int").alias("val"), (F.col("event_id") % 4 - 1).cast("int").alias("hx"), F.lit(1).alias("hy"))
    return S.replay_events(steps, e, mirror=True).select("macro_id", "seq", "pos", "t", "type", "id", "hx")


def insert_rows(spark, d):
    new = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("n_name"), F.lit(0).alias("seq"))
    x = _nation_list(spark, d)
    return O.insert_after(x, ["n_regionkey"], "seq", 1, new).unionByName(O.insert_after(x, ["n_regionkey"], "seq", None, new).withColumn("n_regionkey", F.col("n_regionkey") + 100))


def replace_row(spark, d):
    x = O.replace_at(_nation_list(spark, d), "seq", F.lit(1), {"n_name": F.lit("new")})
    return x.withColumn("inside", O.in_bounds(F.col("seq") + 2, F.lit(5)))


def restore_order(spark, d):
    x = _nation_list(spark, d)
    return O.restore(x.where("seq < 2"), x.withColumn("n_name", F.lower("n_name")), ["n_regionkey"], "seq", F.col("seq").isin(0, 2, 3))


def first_device(spark, d):
    x = table(spark, d, "nation").select("n_nationkey", "n_name")
    return O.first_of_either(x, "n_name", "n_nationkey", [None, "NATION_07", "NATION_03", x.orderBy("n_nationkey").first()["n_name"]])


def name_set(spark, d):
    x = table(spark, d, "nation")
    return O.name_set(x, ["n_regionkey"], "n_name", F.lit("none")).select("n_regionkey", F.array_join("names", ",").alias("names"), "has")


def bracketed(spark, d):
    kind = L.lookup({"signup": "start", "error": "stop"}, F.col("event_type"), F.col("event_type"))
    e = table(spark, d, "events").select("user_id", "ts", "event_id", kind.alias("kind"))
    return C.brackets(e, ["user_id"], ["ts", "event_id"], "kind").groupBy("user_id", "session").agg(F.count("*").alias("n"))


def template_splice(spark, d):
    text = F.format_string('[["wait", %d], ["jump", 1], {"type": "press", "btn": "B"}, ["dir", "%s"], ["release"]]', F.col("n_nationkey"), F.lit(NEUTRAL))
    x = table(spark, d, "nation").select("n_nationkey", F.posexplode(J.template_steps(text)).alias("pos", "s"))
    return x.select("n_nationkey", "pos", "s.type", "s.delay", "s.dir", "s.btn", J.step_text(F.col("s")).alias("text"))


def sorted_keys(spark, d):
    m = F.map_from_arrays(F.array(F.lit(30), F.col("n_nationkey").cast("int"), F.lit(-1)), F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(O.sorted_keys(m), ",").alias("keys"))


QUERIES = {f.__name__: f for f in (change_detect, near_dup_suppress, compile_steps, compile_mirrored, normalize_steps, decode_events, step_display, new_steps, running_clock, repeat_expand, mirror_lookup, fuse_directions, button_parse, remap_ids, elapsed_time, merge_sources, rising_edges, session_bracket, debounce_last, first_match, renumber_after_delete, rebind, lowest_free, distinct_first_seen, last_300, anti_then_union, json_field, move_down, bindings_join, macro_sizes, clamp_inputs, subrates, move_up, duplicate_row, delete_row, splice_rows, direction_codes, combo_split, id_range, process_match, name_of_index, inverse_map, pad_events, pad_events_while_down, replay, insert_rows, replace_row, restore_order, first_device, name_set, bracketed, template_splice, sorted_keys)}

_dirs = "[" + ", ".join(f"'{k}'" for k in DIRECTIONS) + "]"
_case = lambda at, items: f"CASE {at} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in items.items())
_mirror = {k: f"'{L.NAME_OF[-x, y]}'" for k, (x, y) in DIRECTIONS.items()}
_steps = f"""steps AS (
  SELECT CAST(user_id AS VARCHAR) AS macro_id, event_id AS seq,
         CASE event_type WHEN 'click' THEN 'press' WHEN 'purchase' THEN 'release' WHEN 'view' THEN 'wait' WHEN 'signup' THEN 'tap' WHEN 'error' THEN 'dir' ELSE 'comment' END AS type,
         CAST(floor(value) AS DOUBLE) AS delay, ({_dirs})[event_id % 9 + 1] AS dir,
         CASE WHEN event_id % 2 = 0 THEN 'A+rb' ELSE ' y ' END AS btn, CAST(event_id % 4 AS INTEGER) AS rep
  FROM events)"""
_clock = """clock AS (
  SELECT *, sum(delay + len) OVER (PARTITION BY macro_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - len AS t0
  FROM (SELECT *, CASE WHEN type = 'tap' AND rep > 0 THEN rep * 50 + (rep - 1) * 30 ELSE 0 END AS len FROM steps WHERE type <> 'comment'))"""
_ids = "CASE WHEN btn = 'A+rb' THEN [0, 5] ELSE [3] END"

_list = "r AS (SELECT n_regionkey, n_name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS s, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)"
_name = "([" + ", ".join(f"'{k}'" for k in [*DIRECTIONS, "none"]) + "])[event_id % 10 + 1]"
_vector = {f"{x},{y}": f"'{k}'" for k, (x, y) in DIRECTIONS.items()}

_snap = """snap AS (
  SELECT user_id, event_id, [CAST((event_id + 7 * i) % (i + 2) = 0 AS INTEGER) FOR i IN range(16)] AS b, (event_id % 5 - 2) / 2.0 AS ax, (event_id % 7 - 3) / 3.0 AS ay,
         CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS h0x, CASE event_id % 9 WHEN 0 THEN 1 ELSE 0 END AS h0y,
         CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS h1x, CASE event_id % 5 WHEN 0 THEN 1 ELSE 0 END AS h1y FROM events),
fused AS (
  SELECT *, CASE WHEN h0x <> 0 THEN h0x WHEN b[15] <> b[14] THEN b[15] - b[14] WHEN abs(ax) > 0.5 THEN sign(ax) ELSE 0 END AS x,
         CASE WHEN h0y <> 0 THEN h0y WHEN b[12] <> b[13] THEN b[12] - b[13] WHEN abs(ay) > 0.5 THEN -sign(ay) ELSE 0 END AS y FROM snap),
was AS (SELECT *, lag(x, 1, 0) OVER w AS px, lag(y, 1, 0) OVER w AS py, lag(h1x, 1, 0) OVER w AS p1x, lag(h1y, 1, 0) OVER w AS p1y, lag(b) OVER w AS pb FROM fused WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
ev AS (
  SELECT user_id, event_id, 0 AS k, 'hat' AS type, 0 AS id, NULL AS val, x AS hx, y AS hy FROM was WHERE x <> px OR y <> py
  UNION ALL SELECT user_id, event_id, 1, 'hat', 1, NULL, h1x, h1y FROM was WHERE h1x <> p1x OR h1y <> p1y
  UNION ALL SELECT user_id, event_id, 2 + i, 'btn', i, b[i + 1], NULL, NULL FROM was, range(16) r(i) WHERE b[i + 1] <> coalesce(pb[i + 1], 0) AND {mask})
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_id ORDER BY k) - 1 AS INTEGER) AS pos, type, CAST({id} AS INTEGER) AS id, CAST(val AS INTEGER) AS val, CAST(hx AS INTEGER) AS hx, CAST(hy AS INTEGER) AS hy FROM ev"""

ORACLES = {
    "change_detect": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type",
    "near_dup_suppress": f"""
WITH RECURSIVE o AS (SELECT *, epoch_us(ts) / 1000.0 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, event_id, event_type AS last_type, ms AS last_ms, event_type, true AS kept FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.k, o.event_id,
         CASE WHEN o.event_type = f.last_type AND o.ms - f.last_ms < {DAY_MS} THEN f.last_type ELSE o.event_type END,
         CASE WHEN o.event_type = f.last_type AND o.ms - f.last_ms < {DAY_MS} THEN f.last_ms ELSE o.ms END,
         o.event_type, NOT (o.event_type = f.last_type AND o.ms - f.last_ms < {DAY_MS})
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT event_id, user_id, event_type FROM f WHERE kept""",
    "compile_steps": f"""
WITH {_steps}, {_clock},
b AS (SELECT *, {_ids} AS ids FROM clock),
e AS (
  SELECT macro_id, seq, 0 AS pos, t0 AS t, 'hat' AS type, 0 AS id, NULL AS val, {_case('dir', {k: v[0] for k, v in DIRECTIONS.items()})} ELSE 0 END AS hx, {_case('dir', {k: v[1] for k, v in DIRECTIONS.items()})} ELSE 0 END AS hy FROM b WHERE type = 'dir'
  UNION ALL
  SELECT macro_id, seq, i, t0, 'btn', ids[i + 1], CASE type WHEN 'press' THEN 1 ELSE 0 END, NULL, NULL FROM b, range(2) r(i) WHERE type IN ('press', 'release') AND i < len(ids)
  UNION ALL
  SELECT macro_id, seq, (q * 2 + u) * len(ids) + i, t0 + q * 80 + u * 50, 'btn', ids[i + 1], 1 - u, NULL, NULL
  FROM b, range(4) a(q), range(2) c(u), range(2) r(i) WHERE type = 'tap' AND q < rep AND i < len(ids))
SELECT macro_id, seq, CAST(pos AS INTEGER) AS pos, CAST(t AS DOUBLE) AS t, type, CAST(id AS INTEGER) AS id, CAST(val AS INTEGER) AS val, CAST(hx AS INTEGER) AS hx, CAST(hy AS INTEGER) AS hy FROM e""",
    "compile_mirrored": f"""
WITH {_steps} SELECT macro_id, seq, CAST(-({_case('dir', {k: v[0] for k, v in DIRECTIONS.items()})} ELSE 0 END) AS INTEGER) AS hx, CAST({_case('dir', {k: v[1] for k, v in DIRECTIONS.items()})} ELSE 0 END AS INTEGER) AS hy FROM steps WHERE type = 'dir'""",
    "normalize_steps": f"""
WITH {_steps}, n AS (SELECT *, trunc(delay - 50.5) AS d FROM steps)
SELECT macro_id, seq, 0 AS pos, 'wait' AS type, CAST(d AS DOUBLE) AS delay, NULL AS btn FROM n WHERE d > 0
UNION ALL SELECT macro_id, seq, 1, type, NULL, btn FROM n WHERE type <> 'wait'""",
    "decode_events": f"""
WITH e AS (SELECT *, event_id * 2.5 AS t FROM events),
g AS (SELECT *, round_even(t - lag(t, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d, event_id % 3 - 1 AS hy, event_id % 13 AS id FROM e)
SELECT CAST(user_id AS VARCHAR) AS macro_id, event_id AS seq, 0 AS pos, 'wait' AS type, CAST(d AS DOUBLE) AS delay, NULL AS dir, NULL AS btn FROM g WHERE d > 0
UNION ALL
SELECT CAST(user_id AS VARCHAR), event_id, 1, CASE event_type WHEN 'error' THEN 'dir' WHEN 'click' THEN 'press' ELSE 'release' END, NULL,
       CASE WHEN event_type = 'error' THEN CASE hy WHEN -1 THEN '↘右下' WHEN 0 THEN '→右' ELSE '↗右上' END END,
       CASE WHEN event_type <> 'error' THEN coalesce((['A', 'B', 'X', 'Y', 'LB', 'RB', 'Back', 'Start', 'L3', 'R3', 'Guide'])[id + 1], 'BTN' || id) END FROM g""",
    "step_display": f"""
WITH {_steps}
SELECT macro_id, seq, printf('%3d.  ', row_number() OVER (PARTITION BY macro_id ORDER BY seq)) ||
  CASE type WHEN 'wait' THEN '延迟 ' || CAST(CAST(delay AS BIGINT) AS VARCHAR) || 'ms' WHEN 'press' THEN '按下 ' || btn WHEN 'release' THEN '松开 ' || btn
  WHEN 'dir' THEN '方向 ' || dir WHEN 'tap' THEN '连按 ' || btn || ' ×' || rep || '  (50/30ms)' WHEN 'comment' THEN '// note' ELSE type END AS label FROM steps""",
    "new_steps": f"""
WITH {_steps}
SELECT macro_id, seq, type, CASE WHEN type = 'wait' THEN delay END AS delay, CASE WHEN type = 'dir' THEN dir END AS dir, CASE WHEN type IN ('press', 'release', 'tap') THEN btn END AS btn,
  CASE WHEN type = 'tap' THEN rep END AS rep, CASE WHEN type = 'tap' THEN 50 END AS dur, CASE WHEN type = 'tap' THEN 30 END AS gap, CASE WHEN type = 'comment' THEN 'note' END AS text FROM steps""",
    "running_clock": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) AS clock FROM lineitem",
    "repeat_expand": "SELECT l_linenumber, CAST(rep AS INTEGER) AS rep, count(*) AS n, CAST(rep * 80 AS BIGINT) AS press_at, CAST(rep * 80 + 50 AS BIGINT) AS release_at FROM (SELECT l_linenumber, unnest(range(l_linenumber)) AS rep FROM lineitem) GROUP BY l_linenumber, rep",
    "mirror_lookup": f"SELECT event_id, {_case(f'({_dirs})[event_id % 9 + 1]', _mirror)} END AS mirrored, event_type AS unknown FROM events",
    "fuse_directions": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_linenumber % 3 <> 1 THEN l_linenumber % 3 - 1 WHEN l_suppkey % 3 <> 1 THEN l_suppkey % 3 - 1 WHEN abs((l_partkey % 5 - 2) / 2.0) > 0.5 THEN sign((l_partkey % 5 - 2) / 2.0) ELSE 0 END AS INTEGER) AS axis FROM lineitem",
    "button_parse": "SELECT p_partkey, CASE lower(p_name[1]) WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'x' THEN 2 WHEN 'y' THEN 3 ELSE coalesce(TRY_CAST(CASE WHEN regexp_full_match(p_name[1], '[0-9]') THEN p_name[1] END AS INTEGER), 0) END AS by_name, CAST(p_size AS INTEGER) AS by_number FROM part",
    "remap_ids": "SELECT event_id, CAST(CASE event_id % 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE event_id % 5 END AS INTEGER) AS logical FROM events",
    "elapsed_time": "SELECT event_id, user_id, round_even((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000.0, 1) AS t FROM events",
    "merge_sources": "SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 0 ELSE 1 END AS source, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events WHERE event_type IN ('click', 'view')",
    "rising_edges": "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type = 'click' AND p IS DISTINCT FROM 'click'",
    "session_bracket": "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM events) GROUP BY user_id, session",
    "debounce_last": "SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) WHERE nx IS NULL OR nx >= ts + INTERVAL 6 HOUR",
    "first_match": "SELECT c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer) WHERE k = 1",
    "renumber_after_delete": "SELECT n_nationkey, n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS idx FROM nation WHERE n_regionkey <> 2",
    "rebind": "SELECT c_custkey, CAST(CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN -1 ELSE c_nationkey - (SELECT count(*) FROM nation WHERE n_regionkey = 2 AND n_nationkey < c_nationkey) END AS INTEGER) AS idx FROM customer",
    "lowest_free": "SELECT s_nationkey, (SELECT min(k) FROM range(1, 9) r(k) WHERE NOT EXISTS (SELECT 1 FROM supplier y WHERE y.s_nationkey = x.s_nationkey AND y.s_suppkey % 7 = k)) AS free FROM (SELECT DISTINCT s_nationkey FROM supplier) x",
    "distinct_first_seen": "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY event_type",
    "last_300": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 300",
    "anti_then_union": "SELECT DISTINCT doc_id FROM labels UNION ALL SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "json_field": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "move_down": "WITH r AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS s, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation) SELECT n_regionkey, n_name, CAST(CASE WHEN s = 1 AND n > 2 THEN 2 WHEN s = 2 THEN 1 ELSE s END AS INTEGER) AS seq FROM r",
    "bindings_join": "SELECT event_id, slot, macro_idx FROM events JOIN (VALUES (0, 1, 4), (1, 1, 2), (3, 5, 0)) b(slot, code, macro_idx) ON event_id % 6 = code WHERE event_type = 'click'",
    "macro_sizes": "SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'view') AS n_waits FROM events GROUP BY user_id",
    "clamp_inputs": "SELECT p_partkey, greatest(p_size - 10, 0) AS delay, greatest(p_size - 10, 1) AS rep FROM part",
    "subrates": "SELECT count(*) FILTER (WHERE k % 10 = 0) AS each_1s, count(*) FILTER (WHERE k % 30 = 0) AS each_3s, count(*) FILTER (WHERE k % 50 = 0) AS each_5s FROM (SELECT epoch_us(ts) // 100000 AS k FROM events)",
    "move_up": f"WITH {_list} SELECT n_regionkey, n_name, CAST(CASE WHEN s = 1 AND n > 2 THEN 2 WHEN s = 2 THEN 1 ELSE s END AS INTEGER) AS seq FROM r",
    "duplicate_row": f"WITH {_list} SELECT n_regionkey, n_name, CASE WHEN s > 1 THEN s + 1 ELSE s END AS seq FROM r UNION ALL SELECT n_regionkey, n_name, 2 FROM r WHERE s = 1",
    "delete_row": f"WITH {_list} SELECT n_regionkey, n_name, CASE WHEN s > 1 THEN s - 1 ELSE s END AS seq FROM r WHERE s <> 1",
    "splice_rows": f"WITH {_list} SELECT n_regionkey, n_name, CASE WHEN s >= 2 AND n_regionkey <> 3 THEN s + 2 ELSE s END AS seq FROM r UNION ALL SELECT r_regionkey, r_name, CAST(k + least(2, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)) AS INTEGER) FROM region, range(2) t(k) WHERE r_regionkey <> 3",
    "direction_codes": f"SELECT event_id, CAST({_case(_name, {k: v[0] for k, v in DIRECTIONS.items()})} ELSE 0 END AS INTEGER) AS hx, CAST({_case(_name, {k: v[1] for k, v in DIRECTIONS.items()})} ELSE 0 END AS INTEGER) AS hy, {_case("(event_id % 5 - 2) || ',' || (user_id % 3 - 1)", _vector)} ELSE '{NEUTRAL}' END AS name, CAST(CASE WHEN abs(event_id % 5 - 2) <= 1 THEN 2 - event_id % 5 ELSE event_id % 5 - 2 END AS INTEGER) AS mirrored_x FROM events",
    "combo_split": "SELECT p_partkey, CAST(k AS INTEGER) AS pos, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN p_size ELSE 5 END AS INTEGER) AS button FROM part, range(3) t(k)",
    "id_range": "SELECT CASE WHEN l_linenumber = 1 THEN 'hat' ELSE 'btn' END AS type, CAST(l_quantity AS INTEGER) AS id, count(*) AS n FROM lineitem WHERE l_linenumber = 1 OR l_quantity <= 10 GROUP BY 1, 2",
    "process_match": "SELECT c_custkey, lower(c_name) || CASE WHEN lower(c_name) LIKE '%.exe' THEN '' ELSE '.exe' END = 'customer#000000007.exe' AS same, c_mktsegment LIKE '%BUILD%' AND c_nationkey > 3 AS titled FROM customer",
    "name_of_index": "SELECT s_suppkey, coalesce(n_name, 'unbound') AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey",
    "inverse_map": "SELECT n_nationkey, 3 AS key_of_5, CAST(len(list_distinct([n_nationkey, n_regionkey, 5])) AS INTEGER) AS n_keys, CASE WHEN n_nationkey = 5 THEN 1 ELSE 2 END AS n_put, 5 AS put_2 FROM nation",
    "pad_events": "WITH " + _snap.replace("{mask}", "i NOT BETWEEN 11 AND 14").replace("{id}", "CASE WHEN type = 'btn' AND id IN (1, 2) THEN 3 - id ELSE id END"),
    "pad_events_while_down": "WITH " + _snap.replace("{mask}", "NOT (i BETWEEN 11 AND 14 AND b[12] + b[13] + b[14] + b[15] > 0)").replace("{id}", "id"),
    "replay": f"""
WITH {_steps}, s AS (SELECT * FROM steps WHERE type IN ('press', 'wait') AND CAST(macro_id AS BIGINT) % 2 = 0),
c AS (SELECT *, sum(delay) OVER (PARTITION BY macro_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS t, {_ids} AS ids FROM s)
SELECT macro_id, seq, CAST(i AS INTEGER) AS pos, CAST(t AS DOUBLE) AS t, 'btn' AS type, CAST(ids[i + 1] AS INTEGER) AS id, CAST(NULL AS INTEGER) AS hx FROM c, range(2) r(i) WHERE type = 'press' AND i < len(ids)
UNION ALL SELECT CAST(user_id AS VARCHAR), event_id, 0, CAST(event_id * 2.5 AS DOUBLE), 'hat', 0, CAST(CASE WHEN event_id % 4 = 3 THEN 2 ELSE 1 - event_id % 4 END AS INTEGER) FROM events WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT macro_id FROM s)""",
    "insert_rows": f"WITH {_list}, g AS (SELECT n_regionkey, max(n) AS n FROM r GROUP BY n_regionkey) SELECT n_regionkey, n_name, CASE WHEN s >= 2 THEN s + 1 ELSE s END AS seq FROM r UNION ALL SELECT r_regionkey, r_name, CAST(least(2, coalesce(n, 0)) AS INTEGER) FROM region LEFT JOIN g ON n_regionkey = r_regionkey UNION ALL SELECT n_regionkey + 100, n_name, s FROM r UNION ALL SELECT r_regionkey + 100, r_name, CAST(coalesce(n, 0) AS INTEGER) FROM region LEFT JOIN g ON n_regionkey = r_regionkey",
    "replace_row": f"WITH {_list} SELECT n_regionkey, CASE WHEN s = 1 THEN 'new' ELSE n_name END AS n_name, s AS seq, s + 2 BETWEEN 0 AND 4 AS inside FROM r",
    "restore_order": f"WITH {_list}, back AS (SELECT n_regionkey, lower(n_name) AS n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY s DESC) - 1 AS k FROM r WHERE s IN (0, 2, 3)) SELECT n_regionkey, n_name, s AS seq FROM r WHERE s < 2 UNION ALL SELECT n_regionkey, n_name, CAST(k + least(2, (SELECT count(*) FROM nation x WHERE x.n_regionkey = back.n_regionkey)) AS INTEGER) FROM back",
    "first_device": "SELECT n_nationkey, n_name FROM nation WHERE n_name IN ('NATION_07', 'NATION_03', (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1)) ORDER BY n_nationkey LIMIT 1",
    "name_set": "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, bool_or(n_name = 'none') AS has FROM nation GROUP BY n_regionkey",
    "bracketed": """
WITH c AS (SELECT *, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' END AS control FROM events),
b AS (SELECT *, coalesce(last_value(control IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'start', false) AS running FROM c),
n AS (SELECT *, CAST(count(*) FILTER (WHERE control = 'start' AND NOT running) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM b)
SELECT user_id, session, count(*) AS n FROM n WHERE running AND control IS NULL GROUP BY user_id, session""",
    "template_splice": f"""
SELECT n_nationkey, 0 AS pos, 'wait' AS type, CAST(n_nationkey AS DOUBLE) AS delay, NULL AS dir, NULL AS btn, '{{"type":"wait","delay":' || n_nationkey || '.0}}' AS text FROM nation
UNION ALL SELECT n_nationkey, 1, 'press', NULL, NULL, 'B', '{{"type":"press","btn":"B"}}' FROM nation
UNION ALL SELECT n_nationkey, 2, 'dir', NULL, '{NEUTRAL}', NULL, '{{"type":"dir","dir":"{NEUTRAL}"}}' FROM nation
UNION ALL SELECT n_nationkey, 3, 'release', NULL, NULL, NULL, '{{"type":"release"}}' FROM nation""",
    "sorted_keys": "SELECT n_nationkey, array_to_string(list_sort([30, n_nationkey, -1]), ',') AS keys FROM nation",
}
