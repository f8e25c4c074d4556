"""The text operators against brute force on small fixtures with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import bpe, chat, common, decontaminate, lang_id, line_dedup, lm_score, media, near_dedup, sharding, toxicity

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, extra string, segment int"


def texts():
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(120))
    words = base.split()
    out = [None, "", "   ", "one two", base, base.upper(), base + " tail", " ".join(words[:60] + ["x"] + words[60:]), "A shared line here\nshort\n" + base, "a SHARED line here \n\nshort", "x " * 3000, "Ünï cödé 中文 \U0001f600 you're <|endoftext|> don't  stop\n\n"]
    return [(i, t, "e", 1) for i, t in enumerate(out)] + [(4, base, "again", 2), (None, "no id at all " + base[:50], "n", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_line_dedup(spark, docs, none):
    got = sorted((r.asDict() for r in line_dedup.dedup_lines(docs).collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["extra"]))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in texts():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(math.inf if i is None else i)
    for r in got:
        lines, i = (r["text"] or "").split("\n"), math.inf if r["doc_id"] is None else r["doc_id"]
        stay = [x for x in lines if not (len(key(x)) >= 10 and min(holders[key(x)]) < i)]
        assert (r["kept_text"], r["n_lines"], r["n_dropped"]) == ("\n".join(stay), len(lines), len(lines) - len(stay))
    assert len(got) == len(texts()) and sum(r["n_dropped"] for r in got) >= 3
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(line_dedup.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, line_dedup.op3_line_dedup(spark, SF).collect())) == sorted(want)


def test_line_dedup_goes_on(spark, tmp_path):
    """Runs kept in a folder: two calls drop what one call on all documents drops; a batch that fails leaves no tables."""
    at, rng = f"file://{tmp_path}/runs", random.Random(4)
    rows = [(i, "\n".join(f"line number {rng.randrange(60)}" for _ in range(5))) for i in range(90)]
    make = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")}
    left = tables()
    want = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(make(rows)).collect()}
    got = {}
    for part in (rows[:40], [], rows[40:70], rows[70:]):
        got |= {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(make(part), batches=2, path=at).collect()}
    assert got == want and tables() == left
    with pytest.raises(Exception):
        line_dedup.dedup_lines(make(rows).withColumn("text", F.raise_error(F.lit("lost"))))
    assert tables() == left


def test_clashing_names(spark, docs):
    """Extra columns with the names of working or result columns change no result and stay as they are."""
    names = ["id", "th", "pos", "h", "h1", "h2", "first", "last", "n", "old", "gone", "c0", "_b", "_r", "_q", "_k", "_c", "_ends", "_at", "_base", "y", "half", "held_out", "row", "ha", "word", "a.b"]
    more = docs.select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)])
    full = more.select("*", *[F.lit("?").alias(x) for x in ("kept_text", "n_lines", "n_dropped", "shard", "slot")])
    rows = lambda df, *c: Counter(map(tuple, df.select(*c).collect()))
    out = line_dedup.dedup_lines(full)
    assert len(set(out.columns)) == len(out.columns) and all(out.first()[x] == k for k, x in enumerate(names))
    columns = ("doc_id", "extra", "kept_text", "n_lines", "n_dropped")
    assert rows(out, *columns) == rows(line_dedup.dedup_lines(docs), *columns)
    out = sharding.shuffle_shards(full, 3, key=["doc_id", "text", "extra", "segment"], blocks=8, cells=4)
    assert len(set(out.columns)) == len(out.columns) and all(out.first()[x] == k for k, x in enumerate(names))
    columns = ("doc_id", "extra", "shard", "slot")
    assert rows(out, *columns) == rows(sharding.shuffle_shards(docs, 3, blocks=8, cells=4), *columns)
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (8, 0, 1), (10, 1, 1)], "doc_id long, toxic int, half int")
    assert rows(toxicity.scored(full, labels), "doc_id", "score") == rows(toxicity.scored(docs, labels), "doc_id", "score")
    assert rows(near_dedup.near_duplicates(full), "doc_id", "component_id") == rows(near_dedup.near_duplicates(docs), "doc_id", "component_id")
    items = spark.createDataFrame([(1, " ".join(texts()[4][1].split()[:12]), "x", 3)], "item_id long, text string, term string, df int")
    assert rows(decontaminate.contamination(full, items), "doc_id", "n_hit") == rows(decontaminate.contamination(docs, items), "doc_id", "n_hit")


def test_sharding(spark, docs, none):
    got = sharding.shuffle_shards(docs, 3, blocks=8, cells=4).collect()
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == len(texts())
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert sharding.shuffle_shards(none, 3).count() == 0
    m = sharding.communication_matrix([5, 0, 7, 11], 4, 1)
    assert [sum(r) for r in m] == [5, 0, 7, 11] and sorted(map(sum, zip(*m))) == [5, 6, 6, 6]
    rng = random.Random(2)
    draws = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3
    assert sharding.hypergeometric(rng, 10**9, 10**9, 10**6) > 0


def hits(text, items):
    w = WORDS.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for number, (_, t) in enumerate(items):
        x = WORDS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(x) - 9) if x else 0):
            win = x[k : k + 10]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit.update(range(a, a + len(win)))
                    found.add(number)
    return len(w), len(hit), len(found), sorted(str(items[k][0]) for k in found if items[k][0] is not None)


def test_decontamination(spark, docs, none):
    """In one segment and in several, with items in one block and in several, of shared ids and without one."""
    base = texts()[4][1].split()
    items = [(10, " ".join(base[5:30])), (9, "Two!"), (8, None), (7, ""), (6, "one-two"), (5, " ".join(base[5:30])), (None, " ".join(base[40:60])), (9, "x X x"), (None, "short")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, *map(str, hits(t, items))) for i, t, *_ in texts())
    for block, segment in ((500_000, 1_000_000), (20, 1_000_000), (500_000, 1), (30, 150)):
        got = decontaminate.contamination(docs.coalesce(1), table, block_words=block, segment_tokens=segment).collect()
        assert Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["n_items"]), str(r["item_ids"])) for r in got) == want
    assert len({r["segment"] for r in decontaminate.build_index(docs.coalesce(1), 150).collect()}) > 3
    assert decontaminate.contamination(none, table).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, table.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        decontaminate.search(decontaminate.build_index(docs), table, slop=decontaminate.GAP)


@pytest.mark.parametrize("operator", [decontaminate, near_dedup])
def test_against_sql(spark, operator):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = (decontaminate.op4_decontamination if operator is decontaminate else near_dedup.op9_near_dedup)(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(operator.ORACLE_SQL).select(*got.columns).fetchall())


def test_proximity():
    t = [w.encode() for w in "a b x c a q c b".split()]
    places = {w: np.array([i for i, v in enumerate(t) if v == w]) for w in set(t)}
    assert [list(map(int, x)) for x in decontaminate.near([places[b"a"], places[b"c"]], 1)] == [[4], [7]]
    assert [list(map(int, x)) for x in decontaminate.near([places[b"a"], places[b"c"]], 2)] == [[0, 4], [4, 7]]
    assert decontaminate.phrase([places[b"b"], places[b"x"], places[b"c"]], [1, 2, 0]).tolist() == [1]
    packed = decontaminate.pack(np.array([3, 500, 70_000, 1, 2]), np.array([0, 3, 5]))
    assert [decontaminate.unpack(x).tolist() for x in packed] == [[3, 500, 70_000], [1, 2]]


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    for r in bpe.encode_documents(docs.select("doc_id", "text"), bpe.default_vocabulary()).join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == lib.decode(ids, skip_special_tokens=False) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(none, bpe.default_vocabulary()).count() == 0
    coder, rng = bpe.Coder(bpe.Vocabulary(bpe.default_vocabulary())), random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice(["a", "bb", " ", "\n", "'s", "é", "1", "!", "中", "<|endoftext|>", "　", "\U0001f600"]) for _ in range(rng.randrange(40)))
        assert coder.encode([s])[0].tolist() == lib.encode(s, add_special_tokens=False).ids
    assert coder.decode(np.array([coder.voc.of_byte[0xE4]])) == "�"


def test_media(spark, docs, none):
    stored = media.store_media(docs)
    by_text = defaultdict(set)
    for r in media.media_digest(stored).join(docs.where("doc_id <> 4").select("doc_id", "text"), "doc_id").collect():
        n, payload = media.payload_of(r["text"])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        by_text[r["text"]].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_digest(media.store_media(none)).count() == 0
    shots = media.clips(stored).where("doc_id = 10").orderBy("shot").collect()
    assert shots[0]["start_frame"] == 0 and all(a["end_frame"] == b["start_frame"] for a, b in zip(shots, shots[1:]))


def test_jpeg():
    rng = random.Random(3)
    payload = bytes(rng.randrange(256) for _ in range(384))
    frames = media.frames_of(payload)
    assert media.decode_blocks(frames).tobytes() == payload
    pixels = media.decode_jpeg(frames[0])[..., 0]  # the plain decoder agrees: each block is one grey level
    assert pixels[::8, ::8].tobytes() == payload[:192] and (pixels.reshape(12, 8, 16, 8).std(axis=(1, 3)) == 0).all()
    avi = media.write_avi(frames)
    assert media.read_avi(avi)["frames"] == frames and media.read_avi(avi)["fps"] == media.FPS
    diff = np.array([0.01] * 20 + [0.9] + [0.01] * 20)
    assert media.cuts(diff).tolist() == [21]


def sets_of(rows):
    out = []
    for i, t, *_ in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        out.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def test_near_dedup(spark, docs, none):
    rows = sets_of([r for r in texts() if r[0] is not None])
    own = {i: i for i, _ in rows}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for (a, x), (b, y) in combinations(rows, 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            p, q = sorted((top(a), top(b)))
            own[q] = p
    got = near_dedup.near_duplicates(docs.where("doc_id IS NOT NULL"), block=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((i, len(s), top(i), top(i) == i) for i, s in rows)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_between_components(spark):
    """A chain whose bucket's smallest member isn't linked to all: links between others must still be found."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows, now = [], list(base)
    for i in range(14):
        rows.append((i, " ".join(now), "e", 0))
        now = list(now)
        for k in rng.sample(range(300), 4):
            now[k] = f"v{rng.randrange(10**6)}"
    sets, own = sets_of(rows), list(range(14))
    for (a, x), (b, y) in combinations(sets, 2):
        if 100 * len(x & y) >= 85 * len(x | y):
            p, q = sorted((own[a], own[b]))
            own = [p if v == q else v for v in own]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), block=3)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(own))


def test_sketch_estimate():
    rng = np.random.default_rng(0)
    a = [near_dedup.mix(rng.integers(0, 2**63, 400).astype(np.uint64)) for _ in range(40)]
    b = [np.concatenate([x[:370], near_dedup.mix(rng.integers(0, 2**63, 30).astype(np.uint64))]) for x in a]
    s, t = near_dedup.sketch(a), near_dedup.sketch(b)
    n = np.full(40, 400.0)
    assert abs(near_dedup.likely_similarity(s, t, n, n).mean() - 370 / 430) < 0.02
    assert near_dedup.likely_at_least(s, t, n, n, 0.7).all() and not near_dedup.likely_at_least(s, t, n, n, 0.97).any()
    assert (np.maximum(s[0], s[1]) == near_dedup.sketch([np.union1d(a[0], a[1])])[0]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {101: 100}


def held_against(rows, out, result, classes, strength=100.0):
    got = defaultdict(list)
    for r in result:
        got[r["doc_id"]].append(r)
    cut = [(i, SPACED.findall((t or "").translate(LOWER))) for i, t in rows]
    c = Counter(x for i, w in cut if not out(i) for x in [*w, " "])
    n, v, of = sum(c.values()), len(c), {}
    paths = []
    for i, w in cut:
        at = next(k for k, r in enumerate(got[i]) if r["n_tokens"] == len(w) + 1)
        r = got[i].pop(at)
        assert len(r["classes"]) == len(w) and all(of.setdefault(x, k) == k < classes for x, k in zip(w, r["classes"]))
        paths.append((i, w, r, [classes, *r["classes"], classes]))
    assert not any(got.values())
    pair = np.zeros((classes + 1, classes + 1))
    for i, _, _, p in paths:
        if not out(i):
            np.add.at(pair, (p[:-1], p[1:]), 1)
    share = (pair.sum(0) + 1) / (pair.sum() + classes + 1)
    step = np.log10((pair + strength * share) / (pair.sum(1, keepdims=True) + strength))
    room = [1 + sum(k + 1 for w, k in c.items() if of.get(w) == x) for x in range(classes)]
    for i, w, r, p in paths:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(c[x] > 0 for x in [*w, " "]), n, out(i))
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, " "]), rel_tol=1e-9)
        assert math.isclose(r["score"], step[p[:-1], p[1:]].sum() + sum(math.log10((c[x] + 1) / room[of[x]]) for x in w), rel_tol=1e-9)
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / (len(w) + 1)), rel_tol=1e-9)
    return of, c


@pytest.mark.parametrize("head", [20, 1, 10_000])
def test_lm_score(spark, docs, none, head):
    d = docs.select("doc_id", "text").withColumn("held_out", lm_score.held_out(F.col("doc_id")))
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    got = lm_score.score(d, head=head, clustered=8, classes=3, most=50).collect()
    held_against([(i, t) for i, t, *_ in texts()], out, got, 3)
    assert lm_score.score(none.select("doc_id", "text", F.lit(True).alias("held_out"))).count() == 0
    # nothing to learn from: all words are unknown
    alone = lm_score.score(d.withColumn("held_out", F.lit(True)), head=head, classes=3).collect()
    held_against([(i, t) for i, t, *_ in texts()], lambda i: True, alone, 3)


def test_exchange_clusters():
    """Words that follow one another in turn fall into two classes."""
    m = np.zeros((6, 6))
    m[:3, 3:], m[3:, :3] = 10, 10
    got = lm_score.exchange(m, 2, 10)
    assert len(set(got[:3])) == len(set(got[3:])) == 1 and got[0] != got[3]


def test_lang_id(spark, docs, none):
    pieces = lang_id.Pieces([b"th", b"the", b"he", b"ing"])
    p = np.random.default_rng(1).random((len(pieces.pieces), 2))
    p[0] = 0
    index = {w: i for i, w in enumerate(pieces.pieces)}

    def every(w):
        if not w:
            return np.ones(2)
        return sum(p[index[w[:k]]] * every(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index and k > 0)

    for w in (b"the", b"thing", b"a", "é".encode(), b"hehe"):
        assert np.allclose(lang_id.word_logs(pieces, p, [w])[0], np.log(every(w)))
    q = lang_id.op5_lang_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in q]) > 0.9
    d = docs.withColumn("held_out", F.lit(True))
    got = {r["doc_id"]: r for r in lang_id.predict(d, pieces, ["de", "en"], p).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[0]["score"] == 0 and 0.5 <= got[3]["score"] <= 1
    assert lang_id.learn(none.withColumn("lang", F.lit("en")), pieces)[0] == []
    assert {r["lang_pred"] for r in lang_id.predict(d, pieces, [], np.zeros((len(pieces.pieces), 0))).collect()} == {"und"}


def test_toxicity(spark, docs, none):
    q = toxicity.op1_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in q]), np.array([r["score"] for r in q])
    rank = s.argsort().argsort()
    assert (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum() > 0.9
    assert ((s >= 0.7) & (y == 0)).sum() <= 0.02 * (y == 0).sum()
    facts = toxicity.TokenFacts({"lowei*": 5.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You 1d10t! loweixyz IDIOT fine", facts)))
    assert (f["hits"], f["hidden"], f["near"], f["kinds"]) == (3, 1, 3, 1)
    got = toxicity.scored(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r["score"] for r in got} == {0.0} and len(got) == len(texts())
    x, t = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert t.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def test_toxicity_trees_against_all_splits():
    """A tree of one level is the best of all splits, counted one by one; its leaves are the Newton steps."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (60, 3)).astype(float), (rng.random(60) < 0.4).astype(float)
    w = rng.random(60) + 0.5
    t = toxicity.Trees(rounds=1, depth=1, rate=0.5).fit(x, y, w)
    base = math.log((w * y).sum() / (w * (1 - y)).sum())
    p = 1 / (1 + math.exp(-base))
    g, h = w * (p - y), w * p * (1 - p)
    step = lambda m: (-g[m].sum() / (h[m].sum() + 1), g[m].sum() ** 2 / (h[m].sum() + 1))
    splits = [(step(x[:, f] <= v)[1] + step(x[:, f] > v)[1], f, v) for f in range(3) for v in range(6) if min(h[x[:, f] <= v].sum(), h[x[:, f] > v].sum()) > 0.5]
    _, f, v = max(splits)
    want = base + 0.5 * np.where(x[:, f] <= v, step(x[:, f] <= v)[0], step(x[:, f] > v)[0])
    assert np.allclose(t.raw(x), want)


def test_toxicity_features_by_hand():
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are STUPID!! so $tup1d heyyyy", toxicity.TokenFacts({}))))
    assert (f["fixed"], f["fixed_density"], f["hidden"], f["near"], f["capital_words"], f["obfuscated"], f["stretched"]) == (2, 2 / 6, 1, 2, 2 / 6, 1 / 6, 1 / 6)
    size = len("YOU are STUPID!! so $tup1d heyyyy")
    assert (f["capitals"], f["exclaims"], f["marks"]) == (9 / size, 2 / 6, 3 / size)
    assert math.isclose(f["log_words"], math.log(7)) and math.isclose(f["letter_share"], (size - 5 - 4) / size)
    assert toxicity.features(None, toxicity.TokenFacts({})) == toxicity.features(" \n", toxicity.TokenFacts({})) == [0.0] * len(toxicity.FEATURES)


def test_toxicity_lexicon_and_cases(spark, docs, none):
    units = spark.createDataFrame([("bad", 50, 0), ("rare", 1, 0), ("both", 50, 50), ("worse", 80, 1)], "unit string, p long, n long")
    got = toxicity.learned_lexicon(units, 100, 100)
    want = {u: math.log((p + 0.1) / 101) - math.log((n + 0.1) / 101) for u, p, n in (("bad", 50, 0), ("worse", 80, 1))}
    assert list(got) == ["worse", "bad"] and all(math.isclose(got[u], want[u]) for u in want)
    assert list(toxicity.learned_lexicon(units, 100, 100, most=1)) == ["worse"]
    # null labels and ids are left out, repeated labels count each, documents may be none
    labels = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (8, None), (None, 1), (9, 0), (10, 0)], "doc_id long, toxic int")
    out = toxicity.scored(docs, labels).collect()
    assert len(out) == len(texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (0, 1, 2)}) == 1
    assert toxicity.scored(none, labels).count() == 0


def test_hypergeometric_against_exact_probabilities():
    """Inversion of an even grid of numbers gives each value its exact share of the grid."""
    class Grid:
        def __init__(self, n):
            self.values = iter((i + 0.5) / n for i in range(n))

        def random(self):
            return next(self.values)

    for good, bad, n in ((5, 7, 4), (3, 0, 2), (1, 40, 30), (20, 20, 20)):
        grid, size = Grid(5000), 5000
        got = Counter(sharding.hypergeometric(grid if min(n, good) > max(0, n - bad) else None, good, bad, n) for _ in range(size))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(got[k] / size - p) <= 1.5 / size


def test_sharding_repeated_rows(spark):
    """Rows equal in all columns are dealt each; the sizes stay exact."""
    df = spark.createDataFrame([(1, "x")] * 50 + [(None, None)] * 20 + [(2, "")] * 3, "doc_id long, text string")
    got = sharding.shuffle_shards(df, 4).collect()
    sizes = Counter(r["shard"] for r in got)
    assert sorted(sizes.values()) == [18, 18, 18, 19] and all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter({(1, "x"): 50, (None, None): 20, (2, ""): 3})


def test_media_shots_and_features(spark):
    """A hard change is a cut, in frames and seconds; the feature is recomputed from the payload alone."""
    rows = [(1, "a" * 192 * 30 + "Z" * 192 * 45), (2, "q" * 192 * 3), (3, " ".join(str(k * k) for k in range(4000))), (None, None)]
    stored = media.store_media(spark.createDataFrame(rows, "doc_id long, text string"))
    shots = [(r["doc_id"], r["start_frame"], r["end_frame"], r["start_s"], r["end_s"]) for r in media.clips(stored).where("doc_id < 3").orderBy("doc_id", "shot").collect()]
    assert shots == [(1, 0, 30, 0.0, 1.2), (1, 30, 75, 1.2, 3.0), (2, 0, 3, 0.0, 0.12)]
    text = dict(rows)
    for r in media.media_digest(stored).collect():
        x = np.frombuffer(media.payload_of(text[r["doc_id"]])[1], np.uint8).reshape(-1, 192)
        h = [Counter((f // 16).tolist()) for f in x]
        diff = [sum(abs(a[k] - b[k]) for k in range(16)) / 384 for a, b in zip(h, h[1:])]
        cut = 0
        for i, d in enumerate(diff):
            near = diff[max(0, i - 24) : i + 25]
            cut += d > np.mean(near) + 2 * np.std(near) + 1e-12 and d > 0.15
        assert r["feature"] == f"frames={len(x)};shots={cut + 1};grey={x.mean():.4f};difference={np.mean(diff) if diff else 0:.4f}"


def test_batches_are_bounded_in_bytes(spark):
    """Long texts come in small batches, whatever their number of rows."""
    df = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = [r["n"] for r in common.map_batches(df, lambda bs: ({"n": [sum(map(len, b["text"]))]} for b in bs), "n long").collect()]
    assert sum(sizes) == 60 << 20 and max(sizes) <= common.BATCH_BYTES + (2 << 20)


def test_chat(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = chat.op2_chat(spark, SF)
    want = con.sql(chat.ORACLE_SQL).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_chat_layouts(spark):
    nasty = "\\### Assistant: </turn> ok\\"
    records = [
        {"messages": [{"role": "human", "content": nasty}, {"role": "assistant", "content": None}], "id": 3},
        {"conversations": [{"from": "gpt", "value": "x"}]},
        {"instruction": "do", "input": "this", "output": "done"},
        {"prompt": "p", "response": "r"},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "{")], "conv_id long, json string")
    got = defaultdict(list)
    for r in chat.json_turns(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {0: [("user", nasty), ("assistant", "")], 1: [("assistant", "x")], 2: [("user", "do\n\nthis"), ("assistant", "done")], 3: [("user", "p"), ("assistant", "r")], 4: [(None, None)], 9: [(None, None)], 10: [(None, None)]}
    typed = spark.createDataFrame([(1, "do", "", "done", "z")], "conv_id long, instruction string, input string, output string, extra string")
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(typed).orderBy("turn").collect()] == [("user", "do"), ("assistant", "done")]
    turns = spark.createDataFrame([(1, 0, "us:er\n", nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty)], chat.TURNS)
    r = chat.conversations(turns).first()
    assert [x[:2] for x in chat.read_back(r["formatted"])] == [("us:er\n", nasty), ("assistant", nasty), ("assistant", nasty)]
    assert len(r["loss"]) == 2 and chat.digests(turns).first()["loss_chars"] == 2 * len(nasty)
    assert chat.digests(turns.limit(0)).count() == 0


def test_chat_odd_records(spark):
    """Values that a mapping can't take leave the record as one of unknown layout; parts of texts are joined."""
    said = {"role": "user", "content": "a"}
    parts = [{"type": "text", "text": "b"}, {"type": "text", "text": "c"}]
    records = {
        0: {"messages": [said, None]}, 1: {"messages": [said, "text"]}, 2: {"messages": [said, {"role": "bot", "content": parts}], "more": {"messages": 1}},
        3: {"messages": [{"role": "gpt", "content": parts}]}, 4: {"messages": [said, {"role": "user", "content": [{"type": "image", "url": "u"}]}]}, 5: {"messages": None}, 6: {"messages": "x", "system": "s"},
        7: {"messages": [said, {"role": "user", "content": {"deep": 1}}]}, 8: {"prompt": 5, "response": True}, 9: {"prompt": None, "response": None},
    }
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in records.items()], "conv_id long, json string")
    got = defaultdict(list)
    turns = chat.json_turns(df)
    for r in turns.orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    none = [(None, None)]
    assert got == {0: [("user", "a"), ("", "")], 1: none, 2: [("user", "a"), ("assistant", "bc")], 3: [("assistant", "bc")], 4: none, 5: none, 6: none, 7: none, 8: [("user", "5"), ("assistant", "true")], 9: [("user", ""), ("assistant", "")]}
    out = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    assert {i: r["n_turns"] for i, r in out.items()} == {i: 0 if t == none else len(t) for i, t in got.items()} and out[2]["loss_chars"] == 2
    typed = spark.createDataFrame([(1, [("bot", [("text", "b"), ("text", "c")]), ("user", None)])], "conv_id long, messages array<struct<role:string,content:array<struct<type:string,text:string>>>>")
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(typed).orderBy("turn").collect()] == [("assistant", "bc"), ("user", "")]


def test_chat_mask_and_long_conversations(spark):
    """The mask slices exactly the assistants' texts; null ids are one conversation; malformed text fails at once."""
    rng = random.Random(6)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice("a\\#<:\n </turn>é😀") for _ in range(rng.randrange(30)))
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(900)]), rng.choice(["user", "assistant", None, "a:s#"]), text(), "x") for _ in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    turns = chat.canonical_turns(df)
    whole = {r["conv_id"]: r for r in chat.conversations(turns).collect()}
    ordered = defaultdict(list)
    for i, k, role, t, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        ordered[i].append((role or "", t or ""))
    for r in chat.digests(turns).collect():
        want, got = ordered[r["conv_id"]], whole[r["conv_id"]]
        assert [x[:2] for x in chat.read_back(got["formatted"])] == want
        learned = [t for role, t in want if role == "assistant"]
        assert [chat.plain(got["formatted"][s["start"] : s["end"]]) for s in got["loss"]] == learned
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(r)[1:] == (len(want), sha("".join(f"{a}\n{t}\n" for a, t in want)), len("".join(learned)), sha("".join(learned)), len(got["formatted"]))
    with pytest.raises(ValueError):
        chat.read_back("### user: " + "a" * 100_000)


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def deduped(rows):
    """Brute force of the line dedup stage over (id, text): what stays of each, without texts that it empties."""
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key_of(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key_of(x)) < 10 or min(holders[key_of(x)]) == i]
        if len(stay) == len(lines):
            out[i] = t
        elif any(SPACED.search(x) for x in stay):
            out[i] = "\n".join(stay)
    return out


def first_of_copies(rows, percent):
    """Brute force of near-dedup over (id, text): the smallest id of each component of links by shared shingles."""
    sets, holders, common, root = {}, defaultdict(list), Counter(), {i: i for i, _ in rows}
    for i, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    for ids in holders.values():
        common.update(combinations(sorted(ids), 2))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, k), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[k]) - n):
            a, b = sorted((find(i), find(k)))
            root[b] = a
    return {i for i in root if find(i) == i}


def test_pipeline(spark):
    """Each stage against brute force on its own input; toxicity against the scores of the operator."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        before = dict(rows)
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
        docs = common.written(stage(spark, docs, sf), "test-stage")
        got = docs.collect()
        after = {r["doc_id"]: r["text"] for r in got}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(after) == len(got) < len(rows), name
        if name == "toxicity":
            assert after == {i: t for i, t in rows if not scores[i]}
        if name == "line dedup":
            assert after == deduped(rows) and all(r["n_chars"] == len(r["text"] or "") for r in got)
        if name == "near-dedup":
            assert after == {i: before[i] for i in first_of_copies(rows, 80)}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            cut = lambda w: [w[i : i + 10] for i in range(max(1, len(w) - 9) if w else 0)]
            windows = {tuple(x) for _, t in items for x in cut(decontaminate.words(t))}
            sizes = {len(x) for x in windows}
            clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
            assert after == {i: t for i, t in rows if clean(decontaminate.words(t))}


def test_pipeline_cases(spark, tmp_path):
    """Rows without an id stay where they are clean, whatever other such rows hold; empty tables give empty results."""
    import corpus_pipeline

    item = " ".join(f"b{k}" for k in range(14))
    rng = random.Random(3)
    clean = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3)]
    rows = [(None, clean[0]), (None, clean[1]), (None, f"start {item} end"), (5, clean[2]), (None, clean[2]), (9, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n int")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, got in (("some", docs), ("none", docs.limit(0))):
        got.write.parquet(f"{tmp_path}/{name}.parquet")
        got = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = common.written(stage(spark, got, str(tmp_path)), "test-stage")
            assert got.columns == docs.columns
            # line dedup empties the copy, so it goes; texts without words are linked with nothing
            want = [(None, clean[0]), (None, clean[1]), (5, clean[2]), (9, None), (None, None)] if name == "some" else []
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(want)
        last = corpus_pipeline.STAGES[-1][1](spark, got, str(tmp_path)).collect()
        assert Counter(r["doc_id"] for r in last) == Counter(i for i, _ in want)


def test_most_frequent_keeps_counts_whole(spark):
    counts = spark.createDataFrame([(-k, c, c + 1) for k, c in ((1, 9), (2, 5000), (3, 9), (4, 5000), (5, 1), (6, 70000))], "h long, c long, t long")
    took = lambda n: [-h for h, _ in lm_score.most_frequent(counts, n)]
    assert took(9) == [6, 4, 2, 3, 1, 5] and took(5) == [6, 4, 2, 3, 1] and took(4) == took(3) == [6, 4, 2] and took(2) == [6] and took(0) == []
    assert lm_score.most_frequent(counts.where("c < 0"), 5) == []


def objective(classes, pair):
    """The likelihood's part that classes change: sum of n log n over class pairs, less that over both margins."""
    hot = np.eye(max(classes) + 1)[classes]
    x = hot.T @ pair @ hot
    f = lm_score.xlogx
    return f(x).sum() - f(x.sum(1)).sum() - f(x.sum(0)).sum()


def test_exchange_against_a_recomputed_objective():
    """Each move of one word, recomputed from nothing, is no better than what exchange() ended with; it never falls."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        pair = rng.integers(0, 9, (12, 12)).astype(float) * (rng.random((12, 12)) < 0.6)
        start = np.concatenate([np.arange(10) % 3, [3, 4]])
        got = lm_score.exchange(pair, 3, 50, fixed=2)
        best = objective(got, pair)
        assert best >= objective(start, pair) - 1e-9 and got[-2:].tolist() == [3, 4]
        for w in range(10):
            for k in range(3):
                other = got.copy()
                other[w] = k
                assert objective(other, pair) <= best + 1e-6


@pytest.mark.parametrize("head", [40, 9, 500])
def test_lm_score_classes_of_all_words(spark, head):
    """Words beyond the exchange's block, in the head and beyond it, get classes by their bigrams; scores follow from these."""
    rng = random.Random(8)
    kinds = [[f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(i, " ".join(rng.choices(kinds[j % 2], weights)[0] for j in range(60))) for i in range(90)] + [(90, "a0 new b0 new new"), (91, None), (92, "a59 a59 a59 b59")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") == 90).repartition(3)
    of, c = held_against(rows, lambda i: i == 90, lm_score.score(d, head=head, clustered=8, classes=2, most=50).collect(), 2)
    # a59 also follows itself
    assert {(w[0], x) for w, x in of.items() if w not in ("a59", "new")} in ({("a", 0), ("b", 1)}, {("a", 1), ("b", 0)})
    assert set(of) == set(c) - {" "} | {"new"}


def test_rare_words_meet_in_parts(spark):
    """Words that reach over parts of place_rare() keep all their places."""
    rows = [(i, "x y z " * (i % 3) + f"w{i % 4}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 0)
    table = lm_score.coded(d, [])
    pair = lm_score.bigrams(table.where("NOT held_out"), np.array([3]), 4, 2)
    whole, parts = (Counter(map(tuple, lm_score.place_rare(table, np.array([3]), pair, k).drop("first").collect())) for k in (10**6, 3))
    assert whole == parts and sum(whole.values()) == sum(len(t.split()) for _, t in rows)


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    m, of = rng.poisson(2.0, (9, 9)).astype(float), np.array([0, 1, 2, 0, 1, 3, 4, 4, 4])  # 3 classes, the end, the others
    pair = lambda of: np.eye(5)[of].T @ m @ np.eye(5)[of]
    f = lm_score.xlogx
    value = lambda q: f(q).sum() - f(q.sum(1)).sum() - f(q.sum(0)).sum()
    # each word has as many bigrams before as after, as all tokens do
    for w in (6, 7, 8):
        hot, moved = np.eye(5)[of], [np.where(np.arange(9) == w, b, of) for b in range(3)]
        out, into = np.delete(m[w], w) @ np.delete(hot, w, 0), np.delete(m[:, w], w) @ np.delete(hot, w, 0)
        counts = np.concatenate([out, into, [m[w, w]]]).astype(np.int64)[None]
        assert lm_score.Gains(pair(of)).best(counts)[0] == np.argmax([value(pair(x)) for x in moved])


def test_lang_id_whole_runs():
    """A run longer than a window, and one whose probability underflows, are scored and learned to the last byte."""
    pieces = lang_id.Pieces([b"th", b"the", b"he", b"ing", b"thething"])
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(len(pieces.pieces)), 2).T
    p[0] = 0
    index = {x: i for i, x in enumerate(pieces.pieces)}

    def sums(w, q):
        fw = [np.ones(q.shape[1])]
        for b in range(1, len(w) + 1):
            fw.append(sum(fw[a] * q[index[w[a:b]]] for a in range(max(0, b - 8), b) if w[a:b] in index))
        return fw[-1]

    for w in (b"thethinghe" * 6, b"x" * 39 + b"the" + b"ing" * 13, b"thething" * 5, b"t"):
        assert np.allclose(lang_id.word_logs(pieces, p, [w])[0], np.log(sums(w, p)))
    long = b"thethinghe" * 400
    one, two = lang_id.word_logs(pieces, p, [long])[0], lang_id.word_logs(pieces, p, [long * 2])[0]
    assert np.isfinite(one).all() and (one < -3000).all() and np.allclose(two / one, 2, atol=0.01)
    # expected uses by brute force; each byte of a run belongs to one piece
    w, q = b"thehe", 1e-3
    ways = [[]]
    got = []
    while ways:
        way = ways.pop()
        done = sum(map(len, way))
        if done == len(w):
            got.append(way)
        ways += [way + [w[done:b]] for b in range(done + 1, len(w) + 1) if w[done:b] in index]
    total = sum(q ** len(x) for x in got)
    want = np.zeros(len(pieces.pieces))
    for x in got:
        for y in x:
            want[index[y]] += 3 * q ** len(x) / total
    assert np.allclose(lang_id.expected_counts(pieces, [w], np.array([3.0]), q), want)
    uses = lang_id.expected_counts(pieces, [long], np.array([1.0]), q)
    assert np.isclose(uses @ [len(x) for x in pieces.pieces], len(long))


def test_near_dedup_shared_ids(spark):
    """Texts without an id, or with one id for several texts, each take part with their own sets."""
    rng = random.Random(21)
    new = lambda: [f"w{rng.randrange(10**6)}" for _ in range(80)]
    x, y, z, u = new(), new(), new(), new()
    near = lambda w: " ".join(w + ["tail"])
    rows = [(None, " ".join(x)), (5, near(x)), (None, " ".join(y)), (7, near(y)), (None, " ".join(z)), (3, " ".join(z)), (3, " ".join(u)), (9, near(u)), (None, " ".join(new()))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    found = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in got)
    assert found == Counter([(None, 5, False), (5, 5, True), (None, 7, False), (7, 7, True), (None, 3, False), (3, 3, True), (3, 3, True), (9, 3, False), (None, None, True)])


def test_pipeline_rows_without_own_ids(spark, tmp_path):
    """Copies go also where rows have no doc_id or share one; a clean row stays beside a contaminated one of its doc_id."""
    import corpus_pipeline

    rng = random.Random(4)
    new = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    item, line, x, y, z, u = " ".join(f"b{k}" for k in range(14)), "a line that rows share", new(), new(), new(), new()
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(2)
        got = stages[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        return Counter((r["doc_id"], r["text"]) for r in got.collect())

    got = run("line dedup", [(None, f"{x}\n{line}"), (None, f"{y}\n{line}"), (2, z), (2, z)])
    assert sum(line in (t or "") for _, t in got.elements()) == 1 and got[2, z] == 1 and got.total() == 3
    assert run("near-dedup", [(None, x), (None, x), (None, x + " tail"), (7, y), (7, y), (7, z), (4, u), (None, u)]).total() == 4
    assert run("decontamination", [(5, x), (5, f"start {item} end"), (None, y)]) == Counter([(5, x), (None, y)])


def test_lang_id_long_pieces():
    pieces = lang_id.Pieces([b"th", b"abcdefghijklmnop"])
    p = np.full((len(pieces.pieces), 1), 1e-3)
    p[0] = 0
    assert pieces.longest == 16
    assert np.isclose(lang_id.word_logs(pieces, p, [b"abcdefghijklmnop"])[0, 0], math.log(1e-3))
    # the piece crosses from one window to the next
    assert np.isclose(lang_id.word_logs(pieces, p, [b"x" * 30 + b"abcdefghijklmnop"])[0, 0], 31 * math.log(1e-3))
