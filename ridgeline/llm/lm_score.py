"""LM scoring: a Brown class bigram model. Exchange clustering puts words into classes; a text's probability is the
product of class transitions and word emissions, both smoothed.

Tokens: words of the text with A-Z lower-cased, then one end. Texts are cut into words twice, to count them and to code
them; all else works on coded texts.

1. Word counts, over training texts (c) and over all (t), by a 63-bit hash that stands for the word from here on. Two of
   n distinct words share one with probability n^2 / 2^64. Counts stay a table; they grow with the corpus.
2. The words of the greatest t, at most `head`, are sent to all tasks (a bounded dictionary). A text becomes the ranks
   of its words and, for the rare words beyond the head, their hashes.
3. Bigram counts of the `clustered` most frequent words, of the end and of all others as one: (clustered + 2)^2 at most.
4. Exchange clustering on the driver over that bounded matrix: each word in turn moves to the class in which the
   training bigrams are likeliest, until no word moves or `sweeps` are over. The end and the others stay apart.
5. The other words of the head, then all rare words: each word's bigrams with each class are counted, and the word moves
   from the others to the class where the gain is best. Words of such a block move at once, so a block may have any
   size; it stays distributed. Bigrams with words that have no class yet count as bigrams with the others. Bigrams of
   the head are added up by blocks of words; those of rare words meet in one sort by hash, which also gives each place
   of a rare word its count and class. A rare word has at most 1 / head of all tokens, which bounds a key there.
6. Class transitions over all training tokens, with the classes of all words.

P(text) = product of P(class | class before) * P(word | class); the end is a class of its own and also the start.
P(word | class) = (c + 1) / (N_class + V_class + 1): the last 1 is the class's share for all unknown words.
P(class | before) = (n + strength * P(class)) / (N_before + strength).
A word that training lacks has no bigrams: it takes the class with the most training words that were seen once.

Cases: a null or empty text is one end. Repeated rows count and are scored each. An empty training set gives N = 0, and
all words are unknown. Words of one t are all in the head or all out of it. Extra columns are left behind.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, Shared, crc_mod, documents, map_arrow, map_batches, numbers, release, text_bytes, written

#: The code of the end; codes of words are negative.
END = 0
#: Words of the head whose bigrams are packed together, as 16-bit places.
BLOCK = 256


def tokens(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(LOWER_BYTES).split()


def code_of(word: bytes) -> int:
    """A negative number for the word: 63 bits of its hash."""
    return -1 - (xxhash.xxh3_64_intdigest(word) >> 1)


def word_counts(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """(h, c, t) over docs(text, held_out): counts in training texts and in all; a task holds at most about `most` words."""

    def run(batches):
        held, ends = (Counter(), Counter()), [0, 0]

        def flush():
            for k, out in enumerate(held):
                t = np.fromiter(out.values(), np.int64, len(out))
                yield {"h": np.fromiter(map(code_of, out), np.int64, len(out)), "c": t * (1 - k), "t": t}
                out.clear()

        for b in batches:
            for out, text in zip(b["held_out"], b["text"]):
                held[out].update(tokens(text))
                ends[out] += 1
            if len(held[0]) + len(held[1]) > most:
                yield from flush()
        yield from flush()
        yield {"h": [END], "c": [ends[0]], "t": [sum(ends)]}

    parts = map_batches(docs.select("text", "held_out"), run, "h long, c long, t long")
    return written(parts.groupBy("h").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "lm-counts")


def most_frequent(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """(h, c) of the words of the highest t, at most `most`, by c and h; words of one t are all in or all out.

    A histogram of at most some 10,000 rows gives the least t, so the driver gets `most` words, not those of each task.
    """
    level = F.when(F.col("t") < 4096, F.col("t")).otherwise(4096 + F.floor(F.log2(F.col("t") / 4096) * 100)).cast("long")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("t").alias("least")).collect()
    least, room = None, most
    for b in sorted(bins, key=lambda b: -b["level"]):
        room -= b["n"]
        if room < 0:
            break
        least = b["least"]
    if least is None:
        return []
    return sorted(((r["h"], r["c"]) for r in counts.where(F.col("t") >= least).collect()), key=lambda x: (-x[1], x[0]))


def xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def exchange(bigrams: np.ndarray, classes: int, sweeps: int, fixed: int = 0) -> np.ndarray:
    """The class of each word by exchange clustering: maximises the sum of n log n over class pairs less twice that over
    classes. bigrams: a square matrix; words in order of frequency, dealt to classes in turn at first. The last `fixed`
    words stay in classes of their own, beyond the others'."""
    n, f = len(bigrams), xlogx
    of = np.concatenate([np.arange(n - fixed) % classes, classes + np.arange(fixed)])
    hot = np.zeros((n, classes + fixed))
    hot[np.arange(n), of] = 1
    out, into = bigrams @ hot, bigrams.T @ hot  # by word: to and from each class
    pair = hot.T @ out
    left, right = bigrams.sum(1), bigrams.sum(0)
    row, col = pair.sum(1), pair.sum(0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n - fixed):
            a, self_ = of[w], bigrams[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[a] -= self_
            i[a] -= self_
            # without w
            pair[a] -= o
            pair[:, a] -= i
            pair[a, a] -= self_
            row[a] -= left[w]
            col[a] -= right[w]
            # gain of each class: its row and column change, the cell where they cross counts once
            diagonal = pair.diagonal()
            gain = (f(pair + o) - f(pair)).sum(1) + (f(pair + i[:, None]) - f(pair)).sum(0)
            gain -= f(diagonal + o) - f(diagonal) + f(diagonal + i) - f(diagonal)
            gain += f(diagonal + o + i + self_) - f(diagonal)
            gain -= f(row + left[w]) - f(row) + f(col + right[w]) - f(col)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pair[b] += o
            pair[:, b] += i
            pair[b, b] += self_
            row[b] += left[w]
            col[b] += right[w]
            if b != a:
                moved += 1
                of[w] = b
                out[:, a] -= bigrams[:, w]
                out[:, b] += bigrams[:, w]
                into[:, a] -= bigrams[w]
                into[:, b] += bigrams[w]
        if not moved:
            break
    return of


class Gains:
    """Moves words from the others to the classes of best gain, as exchange() would move each alone.

    pair: bigrams of the classes, the end and, last, the others. A word's counts have 2 * len(pair) + 1 columns: bigrams
    from it to each class, to it from each class, and with itself.
    """

    small = 16

    def __init__(self, pair: np.ndarray):
        self.pair, self.classes, self.c = pair.astype(float), len(pair) - 2, len(pair)
        p = np.concatenate([self.pair[: self.classes].T, self.pair[:, : self.classes]])  # by column of counts: cells of each class
        at = np.arange(self.classes)
        self.cells = p
        # cells where row and column cross, and those of the others, are dealt with apart
        self.apart = np.zeros(p.shape, bool)
        self.apart[at, at] = self.apart[self.c + at, at] = True
        self.apart[self.c - 1] = self.apart[2 * self.c - 1] = True
        self.table = np.stack([self._more(np.arange(len(p)), np.full(len(p), k)) for k in range(self.small + 1)])

    def _more(self, column: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = self.cells[column]
        return np.where(self.apart[column], 0.0, xlogx(x + k[:, None]) - xlogx(x))

    def best(self, counts: np.ndarray) -> np.ndarray:
        """The class of each word by its row of counts."""
        c, n, f = self.c, self.classes, xlogx
        to, from_, own = counts[:, :c], counts[:, c : 2 * c], counts[:, 2 * c].astype(float)
        gain = np.zeros((len(counts), n))
        w, column = np.nonzero(counts[:, : 2 * c])
        k = counts[w, column]
        for a in range(0, len(w), 1 << 15):
            part = slice(a, a + (1 << 15))
            more = self.table[np.minimum(k[part], self.small), column[part]]
            big = np.flatnonzero(k[part] > self.small)
            more[big] = self._more(column[part][big], k[part][big])
            first = np.flatnonzero(np.diff(w[part], prepend=-1))
            gain[w[part][first]] += np.add.reduceat(more, first)
        diagonal = self.pair.diagonal()[:n]
        w, b = np.nonzero(to[:, :n] + from_[:, :n] + own.astype(np.int64)[:, None])
        gain[w, b] += f(diagonal[b] + to[w, b] + from_[w, b] + own[w]) - f(diagonal[b])
        # bigrams with the word leave the cells of the others, those with the others come to the class
        for x, y, cells in ((to, from_, self.pair[:n, -1]), (from_, to, self.pair[-1, :n])):
            w = np.flatnonzero(x[:, -1])
            left = cells - y[w, :n]
            gain[w] += f(left + x[w, -1:]) - f(left)
        for x, sums in ((to, self.pair[:n].sum(1)), (from_, self.pair[:, :n].sum(0))):
            total = x.sum(1) + own
            gain -= f(sums + total[:, None]) - f(sums)
        return gain.argmax(1) if n else np.zeros(len(counts), np.int64)


class Words(dict):
    """word -> its rank in the head, or its code."""

    most = 300_000

    def __init__(self, head: dict[int, int]):
        super().__init__()
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
        h = code_of(word)
        x = self[word] = self.head.get(h, h)
        return x


def coded(docs: DataFrame, head: list[int]) -> DataFrame:
    """docs(doc_id, held_out, text) as a table: row (unique), doc_id, held_out, n (words), ids (32-bit ranks of the words, -1
    for a rare one), rare (64-bit codes of the rare ones), in order."""
    sent = Shared(docs.sparkSession, {h: k for k, h in enumerate(head)})

    def run(batches):
        get, part, row = Words(sent.get()).__getitem__, TaskContext.get().partitionId(), 0
        for b in batches:
            cut = [tokens(t) for t in b["text"]]
            n = np.fromiter(map(len, cut), np.int64, len(cut))
            ids = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(n.sum()))
            rare = ids < 0
            of = np.concatenate([[0], np.cumsum(n)])
            rares = np.concatenate([[0], np.cumsum(rare)])[of]
            codes, ranks = ids[rare].tobytes(), np.where(rare, -1, ids).astype("<i4").tobytes()
            of = of.tolist()
            yield {
                "row": np.arange(row, row + len(n)) + (part << 36), "doc_id": b["doc_id"], "held_out": b["held_out"], "n": n,
                "ids": [ranks[4 * i : 4 * k] for i, k in zip(of, of[1:])], "rare": [codes[8 * i : 8 * k] for i, k in zip(rares.tolist(), rares[1:].tolist())],
            }
            row += len(n)

    schema = "row long, doc_id long, held_out boolean, n long, ids binary, rare binary"
    return written(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), run, schema), "lm-coded", "zstd")


def steps(ids: np.ndarray, n: np.ndarray, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes before and after each token, the ends among them, and the places of the words. classes: by id, -1 is the last."""
    after = np.full(len(ids) + len(n), end, np.int64)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
    after[at] = classes[ids]
    return (np.concatenate([[end], after[:-1]]) if len(after) else after), after, at


def flat(column, kind: str) -> np.ndarray:
    """All numbers of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def transitions(table: DataFrame, of_batch, size: int) -> np.ndarray:
    """Counts of transitions among `size` classes; of_batch gives those before and after each token of a batch."""

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            before, after = of_batch(b)
            total += np.bincount(before * size + after, minlength=size * size)
        at = np.flatnonzero(total)
        yield {"p": at, "k": total[at]}

    got = map_arrow(table, run, "p long, k long").groupBy("p").agg(F.sum("k").alias("k")).toPandas()  # at most size^2 rows
    out = np.zeros(size * size)
    out[got["p"].to_numpy(np.int64)] = got["k"].to_numpy()
    return out.reshape(size, size)


def bigrams(table: DataFrame, classes: np.ndarray, size: int, end: int) -> np.ndarray:
    """transitions() of coded texts by classes of ids, the last for rare words."""
    sent = Shared(table.sparkSession, classes)
    held: list[np.ndarray] = []

    def of_batch(b):
        if not held:
            held.append(sent.get())
        return steps(flat(b.column("ids"), "<i4"), numbers(b.column("n")), held[0], end)[:2]

    return transitions(table.select("n", "ids"), of_batch, size)


def place_head(table: DataFrame, of: np.ndarray, few: int, pair: np.ndarray) -> np.ndarray:
    """Classes of the head's words from number `few` on, by their bigrams with the classes `of` of ids (others for the rest)."""
    spark, size, words = table.sparkSession, len(pair), len(of) - 1 - few
    width, end = 2 * size + 1, size - 2
    sent, best = Shared(spark, of), Shared(spark, Gains(pair))

    def contexts(batches):
        classes, total = sent.get(), np.zeros(words * width, np.int32)
        for b in batches:
            ids, n = flat(b.column("ids"), "<i4"), numbers(b.column("n"))
            before, after, place = steps(ids, n, classes, end)
            every = np.full(len(after) + 1, -2, np.int64)
            every[place] = ids
            own = np.flatnonzero(ids >= few)
            at, row = place[own], (ids[own].astype(np.int64) - few) * width
            np.add.at(total, row + np.where(every[at + 1] == every[at], width - 1, after[at + 1]), 1)
            apart = (at == 0) | (every[at - 1] != every[at])
            np.add.at(total, (row + size + before[at])[apart], 1)
        at = np.flatnonzero(total)
        block, cell = np.divmod(at, BLOCK * width)
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)).tolist()
        for a, z in zip(cuts, cuts[1:]):
            yield {"block": [int(block[a])], "at": [cell[a:z].astype("<u2").tobytes()], "k": [total[at[a:z]].astype("<u4").tobytes()]}

    def place(batches):
        g, now, total = best.get(), None, None

        def done():
            k = min(BLOCK, words - now * BLOCK)
            return {"w": np.arange(now * BLOCK, now * BLOCK + k), "class": g.best(total.reshape(BLOCK, width)[:k])}

        for b in batches:
            for block, at, k in zip(*(b.column(c).to_pylist() for c in ("block", "at", "k"))):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(BLOCK * width, np.int64)
                total[np.frombuffer(at, "<u2")] += np.frombuffer(k, "<u4")
        if now is not None:
            yield done()

    assert BLOCK * width < 1 << 16
    parts = map_arrow(table.select("n", "ids"), contexts, "block long, at binary, k binary").repartition("block").sortWithinPartitions("block")
    out = np.zeros(words, np.int64)
    for r in map_arrow(parts, place, "w long, class long").collect():  # at most `head` rows
        out[r["w"]] = r["class"]
    return out


def place_rare(table: DataFrame, classes: np.ndarray, pair: np.ndarray, at_once: int = 200_000) -> DataFrame:
    """(row, at, c, class, first): for each rare word of each coded text its number there, its count in training and its class, -1
    where training lacks it; first marks one row of each word. By the word's bigrams with `classes` of ids (others for rare
    words), which meet in one sort by word."""
    spark, size = table.sparkSession, len(pair)
    width, end = 2 * size + 1, size - 2
    sent, best = Shared(spark, classes), Shared(spark, Gains(pair))

    def contexts(batches):
        """context: to * 256 + from, where `size` stands for the word itself; -1 in held-out texts."""
        of = sent.get()
        for b in batches:
            ids, n, rare = flat(b.column("ids"), "<i4"), numbers(b.column("n")), flat(b.column("rare"), "<i8")
            before, after, place = steps(ids, n, of, end)
            at = place[ids < 0]
            same = (np.diff(at) == 1) & (rare[1:] == rare[:-1])
            to, from_ = after[at + 1], before[at]
            to[:-1][same] = size
            from_[1:][same] = size
            count = np.fromiter(map(len, b.column("rare").to_pylist()), np.int64, len(n)) // 8
            row, out = np.repeat(numbers(b.column("row")), count), np.repeat(numbers(b.column("held_out")), count)
            number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            yield {"h": rare, "row": row, "at": number, "context": np.where(out, -1, to * 256 + from_)}

    def place(batches):
        g = best.get()
        # a word seen once in training: its class follows from its context alone
        to, from_ = np.divmod(np.arange(size * size), size)
        once = np.zeros((size * size, width), np.int64)
        once[np.arange(len(once)), to] = 1
        once[np.arange(len(once)), size + from_] = 1
        once = g.best(once)

        def done(h, row, at, context):
            word = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
            trained = context >= 0
            c = np.bincount(word[trained], minlength=word[-1] + 1)
            of = np.full(len(c), -1, np.int64)
            to, from_ = np.divmod(np.where(trained, context, 0), 256)
            lone = trained & (c[word] == 1)
            of[word[lone]] = once[to[lone] * size + from_[lone]]
            many = np.flatnonzero(c > 1)
            for a in range(0, len(many), 8192):
                part = many[a : a + 8192]
                i, z = np.searchsorted(word, [part[0], part[-1] + 1])
                use = trained[i:z] & (c[word[i:z]] > 1)
                k = np.searchsorted(part, word[i:z][use]) * width
                t, f = to[i:z][use], from_[i:z][use]
                counts = np.bincount(k + np.where(t == size, width - 1, t), minlength=len(part) * width)
                counts += np.bincount((k + size + f)[f < size], minlength=len(part) * width)
                of[part] = g.best(counts.reshape(len(part), width))
            return {"row": row, "at": at, "c": c[word], "class": of[word], "first": np.diff(word, prepend=-1) > 0}

        held, n = [], 0
        for b in batches:
            held.append([numbers(b.column(c)) for c in ("h", "row", "at", "context")])
            n += len(held[-1][0])
            if n >= at_once:
                x = [np.concatenate(c) for c in zip(*held)]
                last = np.searchsorted(x[0], x[0][-1])  # the last word may go on
                if last:
                    yield done(*(c[:last] for c in x))
                held = [[c[last:] for c in x]]
                n = len(held[0][0])
        if n:
            yield done(*(np.concatenate(c) for c in zip(*held)))

    found = map_arrow(table.select("row", "held_out", "n", "ids", "rare"), contexts, "h long, row long, at int, context int")
    return written(map_arrow(found.repartition("h").sortWithinPartitions("h"), place, "row long, at int, c int, class int, first boolean"), "lm-rare")


def resolved(table: DataFrame, rare: DataFrame, classes: np.ndarray, counts: np.ndarray, room: np.ndarray, unknown: int, ends: int, total: int) -> DataFrame:
    """Coded texts as doc_id, held_out, n_tokens, n_known, base_score, emission (log10 of all words given their classes), classes."""
    sent = Shared(table.sparkSession, (np.append(classes, -1), np.append(counts, 0), np.log10(room)))
    share = math.log10(total)

    def run(batches):
        of_id, count, log_room = sent.get()
        log_count = np.log10(count + 1)
        for b in batches:
            ids, n = flat(b.column("ids"), "<i4"), numbers(b.column("n"))
            of, c, log_c = of_id[ids], count[ids], log_count[ids]
            lists, sizes = b.column("met"), numbers(b.column("met").value_lengths().fill_null(0))
            met, at = lists.flatten(), np.flatnonzero(ids < 0)
            rares = np.fromiter(map(len, b.column("rare").to_pylist()), np.int64, len(n)) // 8
            at = at[np.repeat(np.cumsum(rares) - rares, sizes) + numbers(met.field("at"))]
            of[at], c[at] = numbers(met.field("class")), numbers(met.field("c"))
            log_c[at] = np.log10(c[at] + 1)
            of[of < 0] = unknown
            doc, k, packed = np.repeat(np.arange(len(n)), n), len(n), of.astype(np.uint8).tobytes()
            cuts = np.concatenate([[0], np.cumsum(n)]).tolist()
            yield {
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "n_tokens": n + 1, "n_known": np.bincount(doc, c > 0, k).astype(np.int64) + (ends > 0),
                "base_score": np.bincount(doc, log_c, k) + math.log10(ends + 1) - (n + 1) * share, "emission": np.bincount(doc, log_c - log_room[of], k),
                "classes": [packed[i:z] for i, z in zip(cuts, cuts[1:])],
            }

    # one list a text, bounded by its words
    met = rare.groupBy("row").agg(F.collect_list(F.struct("at", "c", "class")).alias("met"))
    full = table.join(met, "row", "left").select("doc_id", "held_out", "n", "ids", F.substring("rare", 1, 1 << 30).alias("rare"), "met")
    return written(map_arrow(full, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"), "lm-classes", "zstd")


def class_steps(b, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = numbers(b.column("n_tokens")) - 1
    return (*steps(np.arange(int(n.sum())), n, flat(b.column("classes"), "u1").astype(np.int64), end)[:2], n)


def score(docs: DataFrame, head: int = 100_000, clustered: int = 1_000, classes: int = 64, sweeps: int = 4, strength: float = 100.0, most: int = 500_000) -> DataFrame:
    """docs(doc_id, held_out, text) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity and
    classes (a byte for each word); the model learns from the rows that are not held out."""
    assert 0 < classes <= 120
    spark = docs.sparkSession
    counted = word_counts(docs, most)
    n, v = (x or 0 for x in counted.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    ends = (counted.where(F.col("h") == END).agg(F.sum("c")).first()[0]) or 0
    top = most_frequent(counted.where(F.col("h") < END), head)
    table = coded(docs, [h for h, _ in top])
    trained = table.where("NOT held_out")
    counts = np.array([c for _, c in top], np.int64)
    known = int((counts > 0).sum())
    few = min(clustered, known)

    # the first block; the end and the others are classes of their own
    of = np.full(len(top) + 1, few + 1)
    of[:few] = np.arange(few)
    first = bigrams(trained, of, few + 2, few)
    found = exchange(first, classes, sweeps, fixed=2)
    hot = np.zeros((few + 2, classes + 2))
    hot[np.arange(few + 2), found] = 1
    of[:] = classes + 1
    of[:few] = found[:few]
    # the head's other words, then the rare ones
    if few < len(top):
        of[few:-1] = place_head(trained, of, few, hot.T @ first @ hot)
        of[known:-1] = classes + 1
    rare = place_rare(table, of, bigrams(trained, of, classes + 2, classes))

    words, singles, room = np.zeros(classes, np.int64), np.zeros(classes, np.int64), np.ones(classes + 1)
    np.add.at(room, of[:known], counts[:known] + 1)
    np.add.at(singles, of[:known], counts[:known] == 1)
    for r in rare.where("first AND c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():
        room[r["class"]] += r["n"] + r["v"]
        singles[r["class"]] += r["once"]
    of[known:-1] = -1
    texts = resolved(table, rare, of[:-1], counts, room, int(singles.argmax()), ends, n + v + 1)

    release(counted, table, rare)

    pair = transitions(texts.where("NOT held_out").select("n_tokens", "classes"), lambda b: class_steps(b, classes)[:2], classes + 1)
    share = (pair.sum(0) + 1) / (pair.sum() + classes + 1)
    sent = Shared(spark, np.log10((pair + strength * share) / (pair.sum(1, keepdims=True) + strength)))

    def run(batches):
        log_step = sent.get()
        for b in batches:
            before, after, k = class_steps(b, classes)
            doc = np.repeat(np.arange(len(k)), k + 1)
            value = numbers(b.column("emission")) + np.bincount(doc, log_step[before, after], len(k))
            out = {c: b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "classes")}
            yield out | {"train_tokens": np.full(len(k), n, np.int64), "score": value, "perplexity": 10.0 ** (-value / (k + 1))}

    return map_arrow(texts, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double, classes binary")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 7) == 2


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score(docs).drop("classes")


#: The model can't be written in SQL; the tests hold counts, base scores, classes and scores against brute force.
ORACLE_SQL = None
