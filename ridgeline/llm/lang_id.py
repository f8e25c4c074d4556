"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a distribution over the vocabulary's pieces, as bytes. A word's probability is the sum over all ways to
cut it into pieces, by the forward algorithm: alpha[j] = sum over pieces ending at j of alpha[j - len] * p(piece). All
single bytes are pieces, so every word has a probability. Words of equal length run together in numpy: substrings are
found by a rolling hash in an open table, and a table holds the probabilities of all languages side by side.

Learning: one pass of expectation-maximisation. Expected counts of pieces come from forward and backward sums under
equal piece probabilities, each text counting for its language; they are smoothed towards equal. Texts are learned from a bounded
sample: at most `per_language` documents of each language, by the smallest hash of id and text, whole.

Words are whole runs of letters, A-Z lower-cased; a long run is summed window by window. Their log probabilities add up over the text.

Cases: a null text or one without a letter is `und` with score 0. With no training rows all texts are `und`. Ties go
to the language that sorts first. Repeated rows are scored each; extra columns are left behind.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Shared, crc_mod, documents, map_batches, text_bytes

# Fixed values of the rolling hash.
MULTIPLIER, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
BITS = 19

_words = regex.compile(r"\p{L}+").findall


class Pieces:
    """A hash table of a vocabulary's pieces; piece 0 stands for none."""

    def __init__(self, vocabulary: list[bytes]):
        self.longest = max(map(len, [b"-", *vocabulary]))
        single = [bytes([b]) for b in range(256)]
        self.pieces = [b"", *sorted({*single, *(p for p in vocabulary if p)})]
        keys = np.array([self._hash(p) for p in self.pieces], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        size = 1 << BITS
        self.key, self.id = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.probes = 1
        for i in range(1, len(keys)):
            at, n = int((int(keys[i]) * int(SPREAD) % (1 << 64)) >> 64 - BITS), 1
            while self.id[at]:
                at, n = (at + 1) % size, n + 1
            self.key[at], self.id[at] = keys[i], i
            self.probes = max(self.probes, n)

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(MULTIPLIER) + b + 1) % (1 << 64)
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with the hashes h, 0 where there is none."""
        at = (h * SPREAD >> np.uint64(64 - BITS)).astype(np.int64)
        out = np.where(self.key[at] == h, self.id[at], 0)
        todo = np.flatnonzero((out == 0) & (self.id[at] != 0))
        for _ in range(1, self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % len(self.id)
            hit = self.key[at[todo]] == h[todo]
            out[todo[hit]] = self.id[at[todo[hit]]]
            todo = todo[~hit & (self.id[at[todo]] != 0)]
        return out

    def lattice(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece ids by (start, end) for words of one length, chars: words x length."""
        out, n = {}, chars.shape[1]
        c = chars.astype(np.uint64) + np.uint64(1)
        for a in range(n):
            h = np.zeros(len(chars), np.uint64)
            for b in range(a + 1, min(n, a + self.longest) + 1):
                h = h * MULTIPLIER + c[:, b - 1]
                ids = self.find(h)
                if b == a + 1 or ids.any():
                    out[a, b] = ids
        return out


def by_length(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and characters of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    out = []
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out.append((at, np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(len(at), n)))
    return out


def windows(n: int, window: int) -> list[tuple[int, int]]:
    """Consecutive spans of at most `window` that cover n bytes."""
    return [(a, min(n, a + window)) for a in range(0, n, window)]


def word_logs(pieces: Pieces, p: np.ndarray, words: list[bytes], window: int = 40) -> np.ndarray:
    """log P(word) for each language, words x languages. p: pieces x languages, its row 0 is 0.

    The sums that lead to the last `longest` places go from window to window, divided by their greatest.
    """
    out = np.zeros((len(words), p.shape[1]))
    for at, chars in by_length(words):
        n, keep = chars.shape[1], pieces.longest
        for rows in np.array_split(np.arange(len(at)), max(1, len(at) * min(n, window) // 2_000_000)):
            shape = (len(rows), p.shape[1])
            log, carried = np.zeros(shape), [np.ones(shape)]
            for a0, b0 in windows(n, window):
                # places a0 - len(carried) + 1 to b0; pieces that end in the window
                low = a0 - len(carried) + 1
                alpha = carried + [np.zeros(shape) for _ in range(b0 - a0)]
                for (a, b), ids in pieces.lattice(chars[rows, low:b0]).items():  # starts ascend, so alpha[a] is complete
                    if b + low > a0:
                        alpha[b] += alpha[a] * p[ids]
                carried = alpha[-keep:]
                top = np.maximum(np.max(carried, axis=0), 1e-300)
                log += np.log(top)
                carried = [x / top for x in carried]
            out[at[rows]] = log + np.log(np.maximum(carried[-1], 1e-300))
    return out


def expected_counts(pieces: Pieces, words: list[bytes], weights: np.ndarray, p: float) -> np.ndarray:
    """Expected uses of each piece over weighted words when every piece has probability p.

    Forward and backward sums are divided at each place by the greatest of a stretch, so that no length underflows.
    """
    total = np.zeros(len(pieces.pieces))
    for at, chars in by_length(words):
        n = chars.shape[1]
        for rows in np.array_split(np.arange(len(at)), max(1, len(at) * n // 2_000_000)):
            k, lattice = len(rows), pieces.lattice(chars[rows])
            # forward[b] is true forward / exp(up[b]), backward[a] is true backward / exp(down[a])
            forward, backward = np.zeros((n + 1, k)), np.zeros((n + 1, k))
            up, down = np.zeros((n + 1, k)), np.zeros((n + 1, k))
            forward[0], backward[n] = 1, 1
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for a, b in lattice:
                ends.setdefault(b, []).append(a)
                starts.setdefault(a, []).append(b)
            for b in range(1, n + 1):
                for a in ends[b]:
                    forward[b] += forward[a] * np.exp(up[a] - up[b - 1]) * p * (lattice[a, b] > 0)
                up[b] = up[b - 1] + np.log(forward[b])
                forward[b] = 1
            for a in range(n - 1, -1, -1):
                for b in starts[a]:
                    backward[a] += backward[b] * np.exp(down[b] - down[a + 1]) * p * (lattice[a, b] > 0)
                down[a] = down[a + 1] + np.log(backward[a])
                backward[a] = 1
            for (a, b), ids in lattice.items():
                share = np.exp(up[a] + down[b] - up[n]) * p * weights[at[rows]] * (ids > 0)
                total += np.bincount(ids, share, len(total))
    return total


def words_of(text: str | None) -> list[str]:
    return _words(text_bytes(text).translate(LOWER_BYTES).decode("utf-8", "surrogatepass"))


def encoded(words: list[str]) -> list[bytes]:
    return [w.encode("utf-8", "surrogatepass") for w in words]


def learn(docs: DataFrame, pieces: Pieces, per_language: int = 2000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """docs(doc_id, text, lang): the languages and their piece probabilities, pieces x languages."""
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_h", F.xxhash64("doc_id", "text")).select("text", "lang", "_h")
    counts = {r["lang"]: r["n"] for r in some.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # a threshold on the hash takes about per_language documents; the rank then holds the bound exactly
    wide = [F.when(F.col("lang") == l, F.lit(min(1.0, 1.2 * per_language / n + 100 / n))) for l, n in counts.items()]
    if not counts:
        return [], np.zeros((len(pieces.pieces), 0))
    some = some.where((F.col("_h").cast("double") / 2.0**64 + 0.5) <= F.coalesce(*wide))
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_k") <= per_language).repartition("_h").select("lang", "text")
    sent = Shared(docs.sparkSession, pieces)

    def run(batches):
        own = sent.get()
        held: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                held.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in held.items():
            total = expected_counts(own, encoded(list(words)), np.array(list(words.values()), float), 1e-3)
            at = np.flatnonzero(total)
            # whole millionths, so that sums don't depend on their order
            yield {"lang": [lang] * len(at), "piece": at.tolist(), "k": np.rint(total[at] * 1e6).astype(np.int64).tolist()}

    got = map_batches(some, run, "lang string, piece long, k long").groupBy("lang", "piece").agg(F.sum("k").alias("k")).toPandas()  # at most languages x pieces rows
    langs = sorted(counts)
    p = np.zeros((len(pieces.pieces), len(langs)))
    p[got["piece"].to_numpy(np.int64), [langs.index(x) for x in got["lang"]]] = got["k"].to_numpy() / 1e6
    p = (p + smoothing) / (p + smoothing).sum(0)
    p[0] = 0
    return langs, p


def predict(docs: DataFrame, pieces: Pieces, langs: list[str], p: np.ndarray) -> DataFrame:
    """docs(doc_id, held_out, text) as doc_id, held_out, lang_pred, score: the posterior under equal priors."""
    sent = Shared(docs.sparkSession, (pieces, langs, p))

    def run(batches):
        own, names, probability = sent.get()
        index: dict[str, int] = {}
        logs = np.zeros((0, len(names)))
        for b in batches:
            split = [words_of(t) for t in b["text"]]
            if len(index) > 500_000:
                index, logs = {}, logs[:0]
            new = list({w for ws in split for w in ws}.difference(index))
            if new and names:
                logs = np.concatenate([logs, word_logs(own, probability, encoded(new))])
                index.update(zip(new, range(len(index), len(index) + len(new))))
            pred, score = [], []
            for ws in split:
                if not ws or not names:
                    pred.append("und")
                    score.append(0.0)
                    continue
                x = logs[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(np.argmax(x))
                pred.append(names[best])
                score.append(float(1 / np.exp(x - x[best]).sum()))
            yield {"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": score}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0


def default_pieces() -> Pieces:
    """Pieces of the public 32k vocabulary, without the mark of a word's start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return Pieces([model.id_to_piece(i).replace("▁", "").encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def op5_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    pieces = default_pieces()
    langs, p = learn(docs.where("NOT held_out").select("doc_id", "text", "lang"), pieces)
    return predict(docs.select("doc_id", "held_out", "text"), pieces, langs, p)


#: The forward algorithm over a learned model can't be written in SQL; the tests hold it against an explicit sum over
#: segmentations and against held-out accuracy.
ORACLE_SQL = None
