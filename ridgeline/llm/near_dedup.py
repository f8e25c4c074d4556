"""MinHash near-dedup by SetSketch registers: exponentially spaced truncated minima, banded, estimated jointly, verified.

1. Sketch. A text's set are its distinct 5-word shingles (fewer words: the whole sequence as one). Each element gets one
   exponentially distributed value for every register, in ascending order: value j lies in the j-th of m intervals that
   share the exponential's mass, in a register given by a pseudo-random permutation. Once the next interval begins above
   the largest minimum, further values change nothing, so the work is about n + m log m, not n * m. A register is the
   minimum on a logarithmic scale of base 1.001, so registers of two sets agree about as often as the sets are similar;
   maxima of registers are the sketch of the union. Values depend only on the element's hash.
2. Classes. Texts with equal sets (128-bit hash of the sorted elements) form a class, which has a number of its own. A
   component is named by the smallest doc_id of all its classes.
3. Candidates. `bands` bands of `rows` registers are bucket keys. Each member of a bucket is paired with the bucket's
   smallest member, not with all others: pairs are linear in the input however large a bucket is.
4. Estimate. Both sketches and the set sizes give the maximum-likelihood similarity; pairs far below the threshold go.
5. Verify. The full sets decide. Links give components.
6. The rest. Members of one bucket that ended in different components are compared with each other in blocks: each
   pair of blocks is a group of its own, where pairs of different components pass sizes and estimate on registers
   alone. Members that have a partner left get their full sets, and only links come out. So no link between texts that
   share a bucket and pass the estimate is lost, and there is no cap. This is square only in what a bucket holds of
   texts that are no near copies of its smallest member's component.

Two sets share none of 25 bands of 5 registers with probability 4e-7 at similarity 0.85 and 5e-5 at 0.8.

Cases: null, empty and wordless texts have an empty set and are linked with nothing. Rows that share a doc_id each get
the component of their own text. A null doc_id counts as the largest and gives a null component where it is alone. Ties
go to the smaller doc_id. An empty table gives an empty result. Extra columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, components, documents, map_arrow, map_batches, numbers, release, small_batches, text_bytes, whole_groups, written

M, A, BASE, Q = 128, 20.0, 1.001, (1 << 16) - 2
LAST = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """64-bit hashes of words, kept until there are `most`."""

    most = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text_bytes(text).translate(LOWER_BYTES).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out + h[i : n - k + 1 + i])
    return np.unique(out)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of many sets at once, len(sets) x M; of an empty set all are 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), M), np.inf)
    flat, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
    seed = mix(flat + np.uint64(0x9E3779B97F4A7C15))
    start, step = (seed & np.uint64(M - 1)).astype(np.int64), (seed >> np.uint64(8) & np.uint64(M - 1) | np.uint64(1)).astype(np.int64)
    cells = least.reshape(-1)
    for j in range(M):
        low = np.log(M / (M - j)) / A
        open_ = least.max(axis=1) > low
        keep = open_[owner]
        if not keep.any():
            break
        if not keep.all():
            flat, owner, start, step = flat[keep], owner[keep], start[keep], step[keep]
        u = (mix(flat * np.uint64(2) + np.uint64(2 * j + 1)) >> np.uint64(11)) * 2.0**-53
        np.minimum.at(cells, owner * M + (start + j * step) % M, low - np.log1p(-u / (M - j)) / A)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(k, 0, Q + 1).astype("<u2")


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    r = registers[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), r.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r[..., k])
    return key.astype(np.int64)


def _log_likelihood(j, u, v, up, down, same) -> np.ndarray:
    """Of similarity j, given how many registers are larger, smaller and the same; u, v: shares of the sizes."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    x, y = p(u - v * j), p(v - u * j)
    return sum(np.where(c > 0, c * np.log(np.maximum(q, 1e-300)), 0) for c, q in ((up, x), (down, y), (same, 1 - x - y)))


def likely_at_least(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cut: float) -> np.ndarray:
    """Whether likely_similarity() is cut or more: the likelihood is concave, so it must still rise at cut."""
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    u, v = na / (na + nb), nb / (na + nb)
    sizes = (u, v, up, down, M - up - down)
    return (_log_likelihood(cut + 1e-4, *sizes) >= _log_likelihood(cut, *sizes)) & (np.minimum(u / v, v / u) >= cut)


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The maximum-likelihood similarity of sketches a, b (rows x M) of sets with na and nb elements."""
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = M - up - down
    u, v = na / (na + nb), nb / (na + nb)
    def value(j):
        return _log_likelihood(j, u, v, up, down, same)

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        c, d = low + (high - low) / 3, high - (high - low) / 3
        left = value(c) < value(d)
        low, high = np.where(left, c, low), np.where(left, high, d)
    return (low + high) / 2


def sketches(docs: DataFrame, bands: int = 25, rows: int = 5) -> DataFrame:
    """docs(doc_id long, text, th) as doc_id, th, n, set hash (ha, hb), keys of the bands, registers."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, hashes) for t in b["text"]]
            registers = sketch(sets)
            keys = band_keys(registers, bands, rows)
            h = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            signed = lambda x: (x & (2**64 - 1)) - ((x & 2**63) << 1)
            yield {
                "doc_id": b["doc_id"], "th": b["th"], "n": [len(s) for s in sets], "ha": [signed(x) for x in h], "hb": [signed(x >> 64) for x in h],
                "keys": [k.tolist() if len(s) else [] for k, s in zip(keys, sets)], "registers": [r.tobytes() for r in registers],
            }

    return map_batches(docs, run, "doc_id long, th long, n long, ha long, hb long, keys array<long>, registers binary")


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, elements) of the classes in ids(id, doc_id, th, ha); doc_id and th, the text's hash, find a row of each."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t, hashes).tobytes() for t in b["text"]]
            h = [xxhash.xxh3_128_intdigest(s) for s in sets]
            ok = [(x & (2**64 - 1)) - ((x & 2**63) << 1) == ha for x, ha in zip(h, b["ha"])]  # two texts may share doc_id and th
            yield {"id": [i for i, y in zip(b["id"], ok) if y], "elements": [s for s, y in zip(sets, ok) if y]}

    at = docs.join(ids.select("id", "doc_id", "th", "ha"), ["doc_id", "th"]).select("id", "text", "ha")
    return map_batches(at, run, "id long, elements binary").dropDuplicates(["id"])


def _verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, percent: int, cut: float) -> DataFrame:
    """The links among pairs(a, b): by estimate first, then on full sets."""

    def estimate(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), "<u2").reshape(-1, M) for c in ("ra", "rb"))
            na, nb = np.array(b["na"], float), np.array(b["nb"], float)
            ok = likely_at_least(x, y, na, nb, cut) if len(x) else []
            yield {c: [v for v, o in zip(b[c], ok) if o] for c in ("a", "b")}

    def verify(batches):
        for b in batches:
            out: list[tuple[int, int]] = []
            for i, k, x, y in zip(b["a"], b["b"], b["ea"], b["eb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((i, k))
            yield {"a": [p[0] for p in out], "b": [p[1] for p in out]}

    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    pairs = written(map_batches(sized.select("a", "b", "na", "nb", "ra", "rb"), estimate, "a long, b long"), "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(reps.select("id", "doc_id", "th", "ha"), "id")
    sets = written(_full_sets(docs, ids), "near-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    links = written(map_batches(both.select("a", "b", "ea", "eb"), verify, "a long, b long"), "near-links")
    release(pairs, sets)
    return links


def _rest(docs: DataFrame, entries: DataFrame, reps: DataFrame, found: DataFrame, percent: int, cut: float, block: int, bands: int, rows: int) -> DataFrame:
    """Links between different components that share a bucket of entries(band, key, id), found in pairs of blocks.

    A block has at most about `block` members and 32 MB of elements. Pairs of blocks get registers first; full sets
    follow only for members with a partner that the estimate leaves. Counts of common elements are taken there, so only
    members and links come out, not pairs.
    """
    spark = docs.sparkSession
    placed = entries.join(found.withColumnRenamed("node", "id"), "id", "left").join(reps.select("id", "n"), "id").select("band", "key", "id", "n", F.coalesce("component", "id").alias("component"))
    sums = placed.groupBy("band", "key").agg(F.count("*").alias("size"), F.sum("n").alias("elements"), F.min("component").alias("x"), F.max("component").alias("y"))
    k = F.ceil(F.greatest(F.col("size") / block, F.col("elements") / (4 << 20))).cast("int").alias("k")
    members = placed.join(sums.where("x <> y").select("band", "key", k), ["band", "key"])
    # partitions by the pairs to be compared, not by bytes
    work = sums.where("x <> y").agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0.0
    parts = int(min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), work / 2e7)))
    own = members.withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    group = ["band", "key", "lo", "hi"]
    dealt = own.select("band", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i", "id", "component", "n").join(reps.select("id", "registers"), "id")

    def partners(band, lo, hi, ids, comp, n, i, r):
        """(x, y): rows of the left block, each with those of the right block that the estimate leaves."""
        left, right = np.flatnonzero(i == lo), np.flatnonzero(i == hi)
        right = right[np.argsort(n[right], kind="stable")]
        near, small, large = r[right], 100 * n[right], percent * n[right]
        for x in left:
            # sizes that fit are a stretch
            a, z = np.searchsorted(small, percent * n[x]), np.searchsorted(large, 100 * n[x], "right")
            y, same = right[a:z], near[a:z] == r[x]
            # registers agree about as often as the sets; a row's marks are added up as bytes of 64-bit numbers
            agree = (same.view(np.uint64).sum(1) * np.uint64(0x0101010101010101)) >> np.uint64(56)
            ok = (agree >= (cut - 0.05) * M) & (comp[y] != comp[x])
            if lo == hi:
                ok &= ids[y] > ids[x]
            if not ok.any():
                continue
            y, same = y[ok], same[ok]
            # of the buckets that two share, the first takes the pair
            y = y[same[:, : bands * rows].reshape(-1, bands, rows).all(2).argmax(1) == band]
            y = y[likely_at_least(r[x], r[y], np.full(len(y), float(n[x])), n[y].astype(float), cut)]
            if len(y):
                yield x, y

    def blocks(batches):
        """Each pair of blocks that lies whole in a table: the table, where it begins and ends there, and its partners."""
        for table, ends in whole_groups(batches, group):
            whole = [numbers(table.column(c)) for c in ("band", "lo", "hi", "id", "component", "n", "i")]
            r = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, M)
            for a, z in zip(ends, ends[1:]):
                band, lo, hi, *own = (c[a:z] for c in (*whole, r))
                yield table, a, z, partners(int(band[0]), int(lo[0]), int(hi[0]), *own)

    def candidates(batches):
        for table, a, z, pairs in blocks(batches):
            mark = np.zeros(z - a, bool)
            for x, y in pairs:
                mark[x] = mark[y] = True
            if mark.any():
                found = table.slice(a, z - a).filter(pa.array(mark))
                yield {c: found.column(c).combine_chunks() for c in (*group, "i", "id", "component", "n")}

    def link(batches):
        for table, a, z, pairs in blocks(batches):
            own = table.slice(a, z - a)
            ids, n = numbers(own.column("id")), numbers(own.column("n"))
            known, flat = np.unique(np.frombuffer(b"".join(own.column("elements").to_pylist()), np.uint64), return_inverse=True)
            ends, mark, out = np.cumsum(n), np.zeros(len(known), bool), set()
            for x, y in pairs:
                of = flat[ends[x] - n[x] : ends[x]]
                mark[of] = True
                common = np.array([int(mark[flat[ends[t] - n[t] : ends[t]]].sum()) for t in y])
                mark[of] = False
                y = y[100 * common >= percent * (n[x] + n[y] - common)]
                out |= {(min(ids[x], ids[t]), max(ids[x], ids[t])) for t in y}
            got = np.array(sorted(out), np.int64).reshape(-1, 2)
            yield {"a": got[:, 0], "b": got[:, 1]}

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(parts, *group).sortWithinPartitions(*group)

    some = written(map_arrow(together(dealt), candidates, "band int, key long, lo int, hi int, i int, id long, component long, n long"), "near-open")
    ids = some.select("id").distinct().join(reps.select("id", "doc_id", "th", "ha", "registers"), "id")
    sets = written(_full_sets(docs, ids.drop("registers")), "near-sets")
    more = written(map_arrow(together(some.join(sets, "id").join(ids.select("id", "registers"), "id")), link, "a long, b long"), "near-more")
    release(some, sets)
    return more


def _labelled(table: DataFrame, classes: DataFrame, found: DataFrame, hot_share: float) -> DataFrame:
    """(doc_id, n, component_id) of all rows of table. Components are joined to classes, one row each, before rows meet
    classes. Classes of more than hot_share of the rows (100 at least) are at most 1 / hot_share, so they are broadcast."""
    on = ["ha", "hb"]
    named = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(*on, "size", "least", F.coalesce("component", "id").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(names, "component").select(*on, "size", "component_id")
    named = written(named, "near-named")
    most = max(100, (table.where("n > 0").count()) * hot_share)
    hot, cold = named.where(F.col("size") > most), named.where(F.col("size") <= most)
    rows, columns = table.select("doc_id", "n", *on), ["doc_id", "n", "component_id"]
    some = rows.where("n > 0")
    met = some.join(F.broadcast(hot), on).select(columns)
    met = met.union(some.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on).select(columns))
    return met.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 25, rows: int = 5, margin: float = 0.15, block: int = 1024, hot_share: float = 1e-4) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_shingles, component_id, kept; links need 100 * common >= percent * all.

    margin: how far the estimate may lie below the threshold, about 5 deviations of 128 registers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cut = percent / 100 - margin
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    table = written(sketches(docs, bands, rows), "near-sketch")
    some = table.where("n > 0")
    # a class has a number, as several classes may have one smallest doc_id
    sums = some.groupBy("ha", "hb").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("size"))
    classes = written(sums.select("ha", "hb", "first.doc_id", "first.th", "size", F.monotonically_increasing_id().alias("id")).withColumn("least", F.col("doc_id")), "near-classes")
    firsts = classes.select("ha", "hb", "doc_id", "th", "id")
    reps = written(some.join(firsts, ["ha", "hb", "doc_id", "th"]).dropDuplicates(["id"]), "near-reps")
    keyed = reps.select("id", F.posexplode("keys").alias("band", "key"))
    pivots = keyed.groupBy("band", "key").agg(F.min("id").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("band", "key", "pivot")
    entries = written(keyed.join(pivots, ["band", "key"]), "near-entries")
    star = entries.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    links = _verified(docs, star, reps, percent, cut)
    found = components(links, "near-components")
    more = _rest(docs, entries.select("band", "key", "id"), reps, found, percent, cut, block, bands, rows)
    if more.limit(1).count():
        # the components found are stars already, so few rounds are left
        found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more), "near-components")
    label = _labelled(table, classes, found, hot_share).withColumnRenamed("n", "n_shingles")
    # the result needs the sketch table and what _labelled() has written
    release(classes, reps, entries, links, more)
    shown = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return label.select(shown("doc_id").alias("doc_id"), "n_shingles", shown("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


#: All pairs that share a shingle, then the transitive closure of the links: fit for tables of some thousand documents.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(doc_id, m) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT l.b, r.m FROM reach r JOIN links l ON l.a = r.doc_id),
least AS (SELECT doc_id, min(m) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""
