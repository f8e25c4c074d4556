"""Hand-worked cases of the core operators, JSON sources and streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import lookups as L
from ridgeline.operators import capture as C
from ridgeline.operators import lists as O
from ridgeline.operators import steps as S
from ridgeline.schemas import EVENTS, NEUTRAL, STEPS
from ridgeline.sources import json_io
from ridgeline.streaming import stateful

RIGHT = "→右"


def steps(spark, *rows):
    names = ("type", "delay", "dir", "btn", "rep", "dur", "gap", "text")
    return spark.createDataFrame([("m", i, *[r.get(n) for n in names]) for i, r in enumerate(rows)], STEPS)


def fired(df):
    return [(r["t"], r["type"], r["id"], r["val"] if r["type"] == "btn" else [r["hx"], r["hy"]]) for r in df.orderBy("seq", "pos").collect()]


def test_compile(spark):
    s = steps(spark, {"type": "wait", "delay": 100.0}, {"type": "press", "btn": "A+B"}, {"type": "wait", "delay": 50.0}, {"type": "release", "btn": "A"}, {"type": "tap", "btn": "B", "rep": 2, "dur": 50, "gap": 30}, {"type": "dir", "dir": NEUTRAL})
    assert fired(S.compile_steps(s)) == [(100, "btn", 0, 1), (100, "btn", 1, 1), (150, "btn", 0, 0), (150, "btn", 1, 1), (200, "btn", 1, 0), (230, "btn", 1, 1), (280, "btn", 1, 0), (280, "hat", 0, [0, 0])]
    assert fired(S.compile_steps(steps(spark, {"type": "tap", "btn": "A", "rep": 0}, {"type": "press", "btn": "A"}))) == [(0, "btn", 0, 1)]
    assert fired(S.compile_steps(steps(spark, {"type": "foo", "delay": 10.0}, {"type": "press", "btn": "A"}))) == [(10, "btn", 0, 1)]
    assert fired(S.compile_steps(steps(spark, {"type": "dir", "dir": RIGHT}), mirror=True)) == [(0, "hat", 0, [-1, 0])]
    assert fired(S.compile_steps(steps(spark))) == []


def test_decode_and_back(spark):
    e = spark.createDataFrame([("m", 0, 0.5, "btn", 0, 1, None, None), ("m", 1, 2.0, "btn", 0, 0, None, None), ("m", 2, 4.5, "hat", 0, None, 1, 0), ("m", 3, 4.5, "btn", 15, 1, None, None)], EVENTS)
    d = S.decode_events(e).orderBy("seq", "pos").collect()
    assert [(r["type"], r["delay"], r["btn"] or r["dir"]) for r in d] == [("press", None, "A"), ("wait", 2, None), ("release", None, "A"), ("wait", 2, None), ("dir", None, RIGHT), ("press", None, "BTN15")]
    again = steps(spark, *[{"type": r["type"], "delay": r["delay"], "dir": r["dir"], "btn": r["btn"]} for r in d])
    assert fired(S.compile_steps(again)) == [(0, "btn", 0, 1), (2, "btn", 0, 0), (4, "hat", 0, [1, 0]), (4, "btn", 0, 1)]


def test_normalise_is_idempotent(spark):
    s = steps(spark, {"type": "wait", "delay": 0.0}, {"type": "press", "btn": "A", "delay": 16.7}, {"type": "wait", "delay": -5.0}, {"type": "dir", "dir": RIGHT, "delay": 0.0})
    once = S.normalize_steps(s).orderBy("seq", "pos").collect()
    assert [(r["type"], r["delay"]) for r in once] == [("wait", 16), ("press", None), ("dir", None)]
    twice = S.normalize_steps(steps(spark, *[r.asDict() for r in once])).orderBy("seq", "pos").collect()
    assert [(r["type"], r["delay"], r["btn"]) for r in twice] == [(r["type"], r["delay"], r["btn"]) for r in once]


def test_toggle_comments(spark):
    s = steps(spark, {"type": "press", "btn": "B"}, {"type": "wait", "delay": 20.0}, {"type": "comment", "text": "gone"}, {"type": "tap"})
    once = S.toggle_comments(s, F.col("seq") != 1)
    assert [(r["seq"], r["type"], r["text"]) for r in once.orderBy("seq").collect()] == [(0, "comment", "(被注释) 按下 B"), (1, "wait", None), (3, "comment", "(被注释) 连按 A ×1  (50/30ms)")]
    assert [r["t"] for r in S.compile_steps(once.drop("disabled_step")).collect()] == []
    back = S.toggle_comments(once, F.col("seq") != 1).drop("disabled_step")
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r) for r in s.where("seq <> 2").collect())


def kept(spark, times, values):
    df = spark.createDataFrame([("s", float(t), v) for t, v in zip(times, values)], "s string, t double, v int")
    return [r["t"] for r in C.suppress_repeats(df, ["s"], ["t"], ["v"], "t", 20).orderBy("t").collect()]


def test_repeats(spark):
    assert kept(spark, [0, 15, 30, 45], [1] * 4) == [0, 30]
    assert kept(spark, [0, 20], [1, 1]) == [0, 20]
    assert kept(spark, [0, 5, 10, 12, 40], [1, 0, 1, 1, 1]) == [0, 5, 10, 40]


def test_buttons_axes_ordinals_bindings(spark):
    names = ["lb", "\tA", "7", "BTN15", "-3", "1_0", "7.5"]
    got = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", L.button_id(F.col("n")).alias("b")).orderBy("i").collect()
    assert [r["b"] for r in got] == [4, 0, 7, 0, -3, 10, 0]
    axes = spark.createDataFrame([(0, 0, 0.5), (0, 0, 0.51), (0, 0, -0.9), (1, -1, -0.9), (0, -1, 0.9)], "h int, p int, s double")
    assert [r[0] for r in axes.select(C.fuse_axis(F.col("h"), F.col("p"), F.col("s"))).collect()] == [0, 1, -1, 1, -1]
    assert O.lowest_free(spark.createDataFrame([("k", 1), ("k", 2), ("k", 4)], "k string, n int"), ["k"], "n").first()["free"] == 3
    binds = spark.createDataFrame([(0, 0), (1, 2), (2, 3)], "s int, idx int")
    gone = spark.createDataFrame([(1,), (2,)], "idx int")
    assert [r["idx"] for r in O.rebind(binds, "idx", gone).orderBy("s").collect()] == [0, -1, 1]
    many = spark.createDataFrame([(i, i if i < 12 else None) for i in range(-1, 13)], "s int, idx int")
    want = [-1, 0, -1, 1, 2, 3, -1, -1, 4, 5, 6, 7, 8, None]
    assert [r["idx"] for r in O.rebind(many, "idx", spark.createDataFrame([(1,), (5,), (6,), (6,), (None,), (99,)], "idx int"), width=3).orderBy("s").collect()] == want
    m = spark.range(1).select(O.invert(F.expr("map(1, 5, 2, 6, 3, 5)")).alias("i"), O.put_one_to_one(F.expr("map(1, 5, 2, 6)"), F.lit(3), F.lit(5)).alias("p")).first()
    assert m["i"] == {6: 2, 5: 3} and m["p"] == {2: 6, 3: 5}


def test_mirror_is_its_own_inverse(spark):
    df = spark.createDataFrame([(n,) for n in L.DIRECTIONS] + [("none",)], "n string")
    assert all(r["n"] == r["m"] for r in df.select("n", L.mirror_name(L.mirror_name(F.col("n"))).alias("m")).collect())


def test_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"name": "p", "hotkey_binds": {"F1": 2}, "macros": [{"name": "m", "events": [{"t": 1.5, "type": "btn", "id": 1, "val": 1}, {"t": 2, "type": "hat", "id": 0, "val": [1, 0]}], "steps": [{"type": "tap", "btn": "A"}]}]}]))
    macros = json_io.read_profiles(spark, str(tmp_path / "p.json")).select(F.explode("macros").alias("m")).select("m.*")
    assert [(r["val"], r["hx"], r["hy"]) for r in json_io.macro_events(macros).orderBy("seq").collect()] == [(1, None, None), (None, 1, 0)]
    assert fired(S.compile_steps(json_io.macro_steps(macros).drop("disabled_step"))) == [(0, "btn", 0, 1), (50, "btn", 0, 0)]
    (tmp_path / "c.json").write_text(json.dumps({"btn_map": {"1": 2}}))
    c = json_io.read_config(spark, str(tmp_path / "c.json"), {"sound_enabled": True}).first()
    assert c["btn_map"] == {1: 2} and c["sound_enabled"] is True
    texts = spark.createDataFrame([("",), ('[{"type": "wait"}]',), ('{"type": "wait"}',)], "x string").select(json_io.steps_from_text(F.col("x")).alias("s")).collect()
    assert [None if r["s"] is None else len(r["s"]) for r in texts] == [0, 1, None]


def test_json_round_trip_and_fallbacks(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = [{"name": f"p{i}", "trigger_btn": i, "hotkey_binds": {"F1": i}, "macros": [{"name": "按", "events": [], "steps": [{"type": "tap", "btn": "A", "_orig": 1}]}]} for i in range(3)]
    (tmp_path / "p.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    first = json_io.read_profiles(spark, at("p.json"))
    json_io.write_json(first.repartition(2), at("out"))
    again = json_io.read_profiles(spark, at("out"))
    assert sorted(r.asDict(True)["name"] for r in again.collect()) == ["p0", "p1", "p2"]
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    json_io.write_json(again, at("out"))
    assert json_io.read_profiles(spark, at("out")).count() == 3
    # no profiles: those of an old configuration, else one default profile with the macros of an old file
    (tmp_path / "c.json").write_text(json.dumps({"profiles": rows[:2], "btn_map": {"1": 2}}))
    (tmp_path / "m.json").write_text(json.dumps(rows[0]["macros"]))
    (tmp_path / "empty.json").write_text("[]")
    for missing in ("none.json", "empty.json"):
        assert [r["name"] for r in json_io.read_profiles(spark, at(missing), at("c.json"), at("m.json")).collect()] == ["p0", "p1"]
        one = json_io.read_profiles(spark, at(missing), at("none.json"), at("m.json")).collect()
        assert len(one) == 1 and one[0]["trigger_btn"] == -1 and [m["name"] for m in one[0]["macros"]] == ["按"]
        assert json_io.read_profiles(spark, at(missing)).first()["macros"] == []
    assert json_io.read_config(spark, at("none.json"), {"sound_enabled": True}).first()["sound_enabled"] is True


def test_import_macros(spark, tmp_path):
    macros = [
        {"name": "a", "events": [{"t": 9, "type": "btn", "id": 0, "val": 1}], "steps": [{"type": "press", "btn": "B", "delay": 7.9}, {"type": "wait", "delay": 0}]},
        {"name": "a", "events": [{"t": 5, "type": "btn", "id": 1, "val": 1}, {"t": 6, "type": "hat", "id": 0, "val": [1, 0]}], "steps": []},
        {"name": "b"},
    ]
    (tmp_path / "m.json").write_text(json.dumps(macros))
    found, got = json_io.import_macros(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in found.orderBy("macro_id").collect()] == [("0", "a"), ("1", "a"), ("2", "b")]
    rows = [(r["macro_id"], r["type"], r["delay"], r["btn"] or r["dir"]) for r in got.orderBy("macro_id", "seq", "pos").collect()]
    assert rows == [("0", "wait", 7, None), ("0", "press", None, "B"), ("1", "wait", 5, None), ("1", "press", None, "B"), ("1", "wait", 1, None), ("1", "dir", None, RIGHT)]
    for text in ('{"name": "a"}', '"x"', ""):
        (tmp_path / "x.json").write_text(text)
        with pytest.raises(ValueError):
            json_io.read_macros(spark, str(tmp_path / "x.json"))


def test_templates(spark):
    texts = ['[["wait", 50], ["jump", 1], {"type": "tap", "btn": "A", "rep": 2}, ["dir", "→右"], [], 5, null]', "", '{"type": "wait"}', "[", None]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(json_io.template_steps(F.col("x")).alias("s")).collect()
    first = [(s["type"], s["delay"], s["dir"], s["rep"]) for s in got[0]["s"]]
    assert first[:3] == [("wait", 50, None, None), ("tap", None, None, 2), ("dir", None, RIGHT, None)] and all(not any(s) for s in first[3:])
    assert [r["s"] for r in got[1:]] == [[]] * 4


def test_labels_without_type(spark):
    s = steps(spark, {}, {"type": "wait"}, {"type": "foo"})
    assert [r["label"] for r in S.display(s).orderBy("seq").collect()] == ["  1.  ?", "  2.  延迟 0ms", "  3.  foo"]


def test_repeats_in_linear_time(spark):
    """One island of 200,000 rows, folded one by one, and rows without a time or value."""
    n = 200_000
    df = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("t"), F.lit(1).alias("v"))
    began = time.perf_counter()
    got = C.suppress_repeats(df, ["s"], ["t"], ["v"], "t", 20)
    assert got.agg(F.count("*"), F.max("t")).first() == (n // 20, n - 20) and time.perf_counter() - began < 30
    odd = spark.createDataFrame([("a", 0, None), ("a", 5, None), ("a", 25, None), ("b", None, 1), ("b", None, 1), (None, 3, 1), (None, 4, 1)], "s string, t long, v int")
    assert sorted(map(str, (tuple(r) for r in C.suppress_repeats(odd, ["s"], ["t"], ["v"], "t", 20).collect()))) == sorted(map(str, [("a", 0, None), ("a", 25, None), ("b", None, 1), ("b", None, 1), (None, 3, 1)]))


def test_pad_events(spark):
    """Hat before buttons before stick, y of the stick upside down; buttons 11 to 14 give the direction; both masks."""
    pad = lambda *down: [int(i in down) for i in range(16)]
    snaps = [
        (0, pad(1), [0.9, 0.9], [(0, 0)]), (1, pad(1, 11, 13), [0.9, 0.9], [(0, 0), (1, 0)]), (2, pad(11), [0.5, -0.51], [(-1, 0), (1, 0)]),
        (3, pad(15), [0.2, -0.51], None), (4, pad()[:4], [0.9], []), (5, None, None, None),
    ]
    df = spark.createDataFrame([("p", *s) for s in snaps], "pad string, seq int, buttons array<int>, axes array<double>, hats array<struct<x:int,y:int>>")
    show = lambda df: [(r["seq"], r["type"], r["id"], r["val"] if r["type"] == "btn" else (r["hx"], r["hy"])) for r in df.orderBy("seq", "pos").collect()]
    plain = [
        (0, "hat", 0, (1, -1)), (0, "btn", 3, 1), (1, "hat", 0, (-1, 1)), (1, "hat", 1, (1, 0)), (2, "btn", 3, 0),
        (3, "hat", 0, (0, 1)), (3, "btn", 15, 1), (4, "hat", 0, (0, 0)),
    ]
    assert show(C.pad_events(df, ["pad"], ["seq"], {1: 3})) == plain
    loose = show(C.pad_events(df, ["pad"], ["seq"], {1: 3}, mask="while_down"))
    assert loose == plain[:6] + [(3, "btn", 11, 0)] + plain[6:]
    ids = spark.createDataFrame([("btn", 11), ("btn", 10), ("hat", 99), ("btn", -1), ("btn", 0)], "type string, id int")
    assert [tuple(r) for r in C.known_ids(ids).collect()] == [("btn", 10), ("hat", 99), ("btn", 0)]


def test_brackets(spark):
    """A start while a session runs is refused, a stop while none runs ignored; sessions without rows go."""
    kinds = ["x", "start", "x", "start", "x", "stop", "x", "stop", "start", "stop", "start", "x", None]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(kinds)], "k string, i int, kind string")
    assert [(r["i"], r["session"]) for r in C.brackets(df, ["k"], ["i"], "kind").orderBy("i").collect()] == [(2, 1), (4, 1), (11, 3), (12, 3)]


def test_stream_over_triggers_with_nulls(spark, tmp_path):
    """State goes from trigger to trigger; nulls equal nulls, as in the batch operators."""
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, 5), ("b", 1, 7), ("a", 14, 5), ("a", 5, None), ("a", 30, 5), ("b", 40, 7), ("b", 41, None), ("a", 50, None)]
    schema = "k string, t long, v int"
    for n, part in enumerate((rows[:4], rows[4:7], rows[7:])):
        spark.createDataFrame(sorted(part, key=lambda r: r[1]), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        for f in (tmp_path / "e").glob("*.parquet"):
            if not f.name.startswith("0"):
                f.rename(tmp_path / "e" / f"0{n}.parquet")
                os.utime(tmp_path / "e" / f"0{n}.parquet", (1_000_000 + n, 1_000_000 + n))
    ordered = [r for part in (rows[:4], rows[4:7], rows[7:]) for r in sorted(part, key=lambda r: r[1])]
    batch = spark.createDataFrame([(i, *r) for i, r in enumerate(ordered)], f"i int, {schema}")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    cases = {
        "n_ch": (stateful.changes(stream(), "k", "t", "v"), C.changes(batch, ["k"], ["i"], ["v"])),
        "n_re": (stateful.suppress_repeats(stream(), "k", "t", "v", 20), C.suppress_repeats(batch, ["k"], ["i"], ["v"], "t", 20)),
    }
    for name, (streamed, want) in cases.items():
        q = streamed.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        q.processAllAvailable()
        assert q.lastProgress["batchId"] >= 2
        q.stop()
        assert sorted(map(str, map(tuple, spark.table(name).collect()))) == sorted(map(str, map(tuple, want.drop("i").collect())))


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ms"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    cases = {
        "ch": (stateful.changes(stream, "user_id", "ms", "event_type"), C.changes(e, ["user_id"], ["ms"], ["event_type"])),
        "re": (stateful.suppress_repeats(stream, "user_id", "ms", "event_type", 86_400_000), C.suppress_repeats(e, ["user_id"], ["ms"], ["event_type"], "ms", 86_400_000)),
    }
    for name, (streamed, batch) in cases.items():
        q = streamed.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r["event_id"] for r in spark.table(name).collect()) == sorted(r["event_id"] for r in batch.collect())
