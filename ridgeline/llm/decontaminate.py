"""Benchmark decontamination: a distributed positional inverted index over the training tokens.

The index is partitioned by document, as search engines shard theirs: a segment holds whole documents of about
`segment_tokens` tokens (more only where one document is longer). For each of its terms it stores one posting list:
the ascending places of the term in the segment, delta-coded. The documents of a segment lie one after another with a
gap between them, so no phrase reaches over. Segments are built where documents are read, without a shuffle, and are
written as a table in the shared folder.

A search sends the benchmark in blocks of `block_words` words, a bound on what is broadcast. Only the postings of the
block's terms are read. Windows are filed under their rarest term in the index, so a segment visits only windows whose
rarest term it holds. A window's terms are taken from the rarest on: each posting list is moved back by its term's offset
and intersected with what is left, which are exact phrase matches. Proximity matches take the terms in order with up
to `slop` more words among them.

Cases: null or empty texts have no words and match nothing; an item of fewer than `window` words, but not none, is one
window; items have numbers of their own, so items that share an item_id each count, and one without an item_id counts
but names nothing in item_ids; repeated documents each have a row; empty tables give empty results. Extra columns are
left behind: results are keyed by doc_id.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Shared, documents, map_batches, text_bytes, written

#: Bytes of words as they are, A-Z lower-cased, all others a blank: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ over UTF-8.
WORD_BYTES = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER_BYTES)
#: Free places between documents; no proximity match may span so many.
GAP = 1000

INDEX = "segment long, term binary, df long, places binary"
MATCH = "doc_id long, segment long, doc_ord long, n_words long, item long, item_id long, start long, end long"


def words(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(WORD_BYTES).split()


def pack(places: np.ndarray, cuts: np.ndarray) -> list[bytes]:
    """The posting lists places[cuts[k]:cuts[k + 1]], each as its first place and differences, in the smallest unsigned
    type that holds them all, after the type's number of bytes as a digit."""
    if len(cuts) < 2:
        return []
    steps = np.diff(places, prepend=0)
    steps[cuts[:-1]] = places[cuts[:-1]]
    most = np.maximum.reduceat(steps, cuts[:-1])
    width = np.select([most < 1 << 8, most < 1 << 16, most < 1 << 32], [1, 2, 4], 8).tolist()
    whole = {n: steps.astype(f"<u{n}").tobytes() for n in set(width)}
    head = {n: str(n).encode() for n in whole}
    ends = cuts.tolist()
    return [head[n] + whole[n][n * i : n * k] for n, i, k in zip(width, ends, ends[1:])]


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<u" + chr(packed[0]), offset=1), dtype=np.int64)


def segment_of(docs: list[tuple[int, list[bytes]]]) -> tuple[list[bytes], list[bytes], list[int], np.ndarray]:
    """Terms, packed places and document frequencies of one segment, and the first place of each document."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    lengths = np.array([len(w) for _, w in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + GAP)[:-1]]).astype(np.int64)
    flat = np.fromiter((ids[t] for _, w in docs for t in w), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(len(docs)), lengths)
    at = np.arange(len(flat)) + doc * GAP
    order = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[order], np.arange(len(ids) + 1))
    at, doc = at[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (flat[order][1:] != flat[order][:-1])
    df = np.add.reduceat(new, cuts[:-1]).tolist() if len(flat) else []
    return list(ids), pack(at, cuts), df, starts


def build_index(docs: DataFrame, segment_tokens: int = 1_000_000) -> DataFrame:
    """The index as a table: rows of INDEX. A segment's documents are the rows with a null term: df is doc_id's rank,
    places holds doc_id, first place and number of words of all its documents, as 64-bit integers."""

    def build(batches):
        part, k = TaskContext.get().partitionId(), 0
        held, n = [], 0

        def flush():
            terms, places, df, starts = segment_of(held)
            seg = part * (1 << 32) + k
            ids = [-(1 << 63) if i is None else i for i, _ in held]
            table = np.array([ids, starts.tolist(), [len(w) for _, w in held]], "<i8").tobytes()
            for a in range(0, len(terms), 20_000):
                m = len(terms[a : a + 20_000])
                yield {"segment": [seg] * m, "term": terms[a : a + m], "df": df[a : a + m], "places": places[a : a + m]}
            yield {"segment": [seg], "term": [None], "df": [len(held)], "places": [table]}

        for b in batches:
            for i, text in zip(b["doc_id"], b["text"]):
                w = words(text)
                held.append((i, w))
                n += len(w) + 1
                if n >= segment_tokens:
                    yield from flush()
                    held, n, k = [], 0, k + 1
        if held:
            yield from flush()

    return written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), build, INDEX), "index")


def phrase(lists: list[np.ndarray], order: list[int]) -> np.ndarray:
    """Places where terms follow one another: offset-adjusted lists, intersected in the given order of offsets."""
    left = lists[order[0]] - order[0]
    for i in order[1:]:
        at = np.searchsorted(lists[i], left + i)
        left = left[lists[i][np.minimum(at, len(lists[i]) - 1)] == left + i]
        if not len(left):
            break
    return left


def near(lists: list[np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of terms in order with up to `slop` other words among them. The next place of
    each term, taken greedily, gives each start its least end."""
    start = end = lists[0]
    for of in lists[1:]:
        at = np.searchsorted(of, end, "right")
        ok = at < len(of)
        start, end = start[ok], of[at[ok]]
        ok = end - start < len(lists) + slop
        start, end = start[ok], end[ok]
    return start, end + 1


class Block:
    """Windows of a block of items, each once, with the items that have it, filed under their rarest term."""

    def __init__(self, items: list[tuple[int, int | None, list[bytes]]], window: int):
        """items: number, item_id, words."""
        self.items = items[0][0] if items else 0, [i for _, i, _ in items]
        self.terms = sorted({t for _, _, w in items for t in w})
        code = {t: k for k, t in enumerate(self.terms)}
        self.flat = np.array([code[t] for _, _, w in items for t in w], np.int32)
        owners: dict[bytes, list[int]] = defaultdict(list)
        first, at = {}, 0
        for number, _, w in items:
            for k in range(max(1, len(w) - window + 1) if w else 0):
                start, length = at + k, min(window, len(w))
                key = self.flat[start : start + length].tobytes()
                first.setdefault(key, (start, length))
                if owners[key][-1:] != [number]:
                    owners[key].append(number)
            at += len(w)
        self.windows = [(*first[k], o) for k, o in owners.items()]

    def file(self, frequency: dict[bytes, int]) -> None:
        """By the index's document frequencies: windows under their rarest term, but not those with a term it lacks."""
        self.rank = np.array([frequency.get(t, 0) for t in self.terms], np.int64)
        self.under: dict[bytes, list] = defaultdict(list)
        for start, length, owners in self.windows:
            of = self.flat[start : start + length]
            least = of[self.rank[of].argmin()]
            if self.rank[least]:
                self.under[self.terms[least]].append((start, length, owners))
        del self.windows

    def matches(self, lists: dict[bytes, np.ndarray], slop: int | None):
        """(starts, ends, numbers of items) of the windows that occur among lists, the places by term."""
        for rarest in lists:
            for start, length, owners in self.under.get(rarest, ()):
                of = self.flat[start : start + length]
                places = [lists.get(self.terms[t]) for t in of.tolist()]
                if any(p is None for p in places):
                    continue
                if slop is None:
                    a = phrase(places, self.rank[of].argsort(kind="stable").tolist())
                    b = a + length
                else:
                    a, b = near(places, slop)
                if len(a):
                    yield a, b, owners


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None, block_words: int = 500_000) -> DataFrame:
    """All matches of items(item_id, text) as spans of words: rows of MATCH, spans of one item merged. A row without an
    item stands for a document in which nothing was found in a block; segment and doc_ord tell repeated doc_ids apart."""
    if slop is not None and window + slop >= GAP:
        raise ValueError(f"window + slop must be less than {GAP}, the gap between documents")
    out = None
    block, n = [], 0
    for number, row in enumerate(items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()):
        w = words(row["text"])
        block.append((number, row["item_id"], w))
        n += len(w)
        if n >= block_words:
            part = _search_block(index, Block(block, window), slop)
            out, block, n = part if out is None else out.union(part), [], 0
    if block or out is None:
        part = _search_block(index, Block(block, window), slop)
        out = part if out is None else out.union(part)
    return out


def _search_block(index: DataFrame, block: Block, slop: int | None) -> DataFrame:
    spark = index.sparkSession
    terms = spark.createDataFrame([(bytearray(t),) for t in block.terms], "term binary")
    found = index.join(F.broadcast(terms), "term")
    block.file({bytes(r["term"]): r["n"] for r in found.groupBy("term").agg(F.sum("df").alias("n")).collect()})  # at most the block's terms
    sent = Shared(spark, block)

    def find(pdf):
        import pandas as pd

        own = sent.get()
        low, item_ids = own.items
        ids, starts, n_words = np.frombuffer(pdf.places[pdf.term.isna()].iloc[0], "<i8").reshape(3, -1)
        lists = {bytes(t): unpack(p) for t, p in zip(pdf.term, pdf.places) if t is not None}
        spans = defaultdict(list)
        for a, b, items in own.matches(lists, slop):
            for i in items:
                spans[i].append((a, b))
        rows, hit = [np.zeros((6, 0), np.int64)], np.zeros(len(ids), bool)
        for i, parts in spans.items():
            a, b = merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            d = np.searchsorted(starts, a, "right") - 1
            hit[d] = True
            rows.append(np.stack([ids[d], d, n_words[d], np.full(len(d), i), a - starts[d], b - starts[d]]))
        rest = np.flatnonzero(~hit)
        got = np.concatenate(rows, axis=1)
        none = [None] * len(rest)
        full = {
            "doc_id": [*got[0].tolist(), *ids[rest].tolist()], "segment": [int(pdf.segment.iloc[0])] * (len(got[0]) + len(rest)), "doc_ord": [*got[1].tolist(), *rest.tolist()],
            "n_words": [*got[2].tolist(), *n_words[rest].tolist()], "item": [*got[3].tolist(), *none], "item_id": [*(item_ids[i - low] for i in got[3].tolist()), *none],
            "start": [*got[4].tolist(), *none], "end": [*got[5].tolist(), *none],
        }
        return pd.DataFrame(full, dtype=object)

    keep = found.select("segment", "term", "places").unionByName(index.where("term IS NULL").select("segment", "term", "places"))
    return keep.groupBy("segment").applyInPandas(find, MATCH)


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the spans [a, b), as disjoint spans in order."""
    order = np.lexsort((b, a))
    a, top = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > top[:-1]
    at = np.flatnonzero(new)
    return a[at], top[np.append(at[1:], len(a)) - 1]


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, segment_tokens: int = 1_000_000, **kw) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (in words)."""
    found = search(build_index(docs, segment_tokens), items, window, **kw)
    spans = F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "item_id", "start", "end")))
    # one document's spans; those of a block are merged already
    per_doc = found.groupBy("segment", "doc_ord").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"))

    def digest(batches):
        for b in batches:
            hit, items = [], []
            for spans in b["spans"]:
                x = np.array([(s["start"], s["end"]) for s in spans], np.int64).reshape(-1, 2)
                a, e = merged(x[:, 0], x[:, 1]) if len(x) else (x[:, 0], x[:, 1])
                hit.append(int((e - a).sum()))
                items.append({s["item"]: s["item_id"] for s in spans})
            names = [sorted(str(i) for i in x.values() if i is not None) for x in items]
            yield {"doc_id": [None if i == -(1 << 63) else i for i in b["doc_id"]], "n_words": b["n_words"], "n_hit": hit, "n_items": [len(i) for i in items], "item_ids": names, "spans": b["spans"]}

    return map_batches(per_doc.select("doc_id", "n_words", "spans"), digest, "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<item:long,item_id:long,start:long,end:long>>")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(documents(spark, sf_dir, "doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: All windows of all documents, for each length that an item's windows have: fit for tables of some thousand documents.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
