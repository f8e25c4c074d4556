"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of lexicon hits (a fixed list and a learned one), the largest and the summed weight of
learned hits, hits near a second-person word, hits found only once obfuscation is undone, and rates of capitals,
exclamation and other punctuation, words with digits or signs inside letters, and stretched letters.

The learned lexicon are whole words and word beginnings of 4 to 6 letters that labelled toxic texts hold far more often
than others. It is learned on one half of the sample for the features of the other, so the trees never see features
that their own labels made; the final lexicon is learned on both halves. Trees are fitted on binned features with
logistic loss; isotonic regression over out-of-half predictions maps their output to a probability.

Learning takes a bounded sample: at most `per_class` labelled rows of each class, by the smallest hash of the id. The
learned lexicon has at most `most` units. Texts never reach the driver: it gets three lexicons, the sample's feature
rows, and nothing else.

Cases: null and empty texts have all features 0 and get the score of that. Without documents with labels of both classes
the score is the rate of toxic labels (0 if there are none). Repeated label rows count each; null labels are left out. Extra
columns are left behind.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, crc_mod, documents, map_arrow, map_batches, release, text_bytes, written

#: Scores from here on are predicted toxic.
THRESHOLD = 0.7

# Common insults, and second-person words of the languages at hand.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic disgusting worthless clown clowns imbecile jerk creep freak ugly vermin filth filthy coward crap damn hate liar pig pigs rat rats".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen tú ti usted ustedes vosotros os su sus".split())
# Signs that stand in for letters.
STAND_INS = str.maketrans("013457@$!|", "oieastasil")

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¡¿"
CAPITALS, MARKS = bytes(range(65, 91)), b"?!*#$%&@"
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())

_letters = regex.compile(r"[^\p{L}]+")
_core = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$")
_inside = regex.compile(r"\p{L}[^\p{L}\p{N}\s'’-]+\p{L}|\p{L}\d+\p{L}|[@$]\p{L}|\p{L}[@$]")
_stretched = regex.compile(r"(\p{L})\1\1")

FEATURES = ["fixed", "fixed_density", "hits", "density", "weight", "weight_density", "strongest", "kinds", "near", "near_density", "hidden", "hidden_density", "capitals", "capital_words", "exclaims", "marks", "obfuscated", "stretched", "log_words", "letter_share"]


def plain(token: str) -> str:
    """The token's letters, lower-cased."""
    return _letters.sub("", token).lower()


def undone(token: str) -> str:
    """The token with stand-ins as letters, signs inside dropped and stretched letters cut to one."""
    return _stretched.sub(r"\1", regex.sub(r"(\p{L})\1{2,}", r"\1", plain(token.lower().translate(STAND_INS))))


def units(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters where it is longer; beginnings carry a mark."""
    return [word, *(word[:k] + "*" for k in range(4, min(6, len(word) - 1) + 1))]


#: Bits of a token's code; above them the index of its lexicon entry.
FIXED, HIDDEN, YOU, ODD, LONG, CAPITAL, SHIFT = 1, 2, 4, 8, 16, 32, 6


class TokenFacts(dict):
    """token -> its code. Most tokens say nothing and have the code 0."""

    most = 400_000

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.index = lexicon, {u: i + 1 for i, u in enumerate(lexicon)}
        self.weights = np.array([0.0, *lexicon.values()])
        self.wholes = {u for u in lexicon if u[-1] != "*"} | INSULTS | SECOND_PERSON
        self.starts = {u[:4] for u in lexicon if u[-1] == "*"}

    def _best(self, word: str) -> int:
        return max(((self.lexicon[u], self.index[u]) for u in units(word) if u in self.lexicon), default=(0.0, 0))[1]

    def _code(self, word: str) -> int:
        if word not in self.wholes and word[:4] not in self.starts:
            return 0
        return FIXED * (word in INSULTS) + YOU * (word in SECOND_PERSON) + (self._best(word) << SHIFT)

    def __missing__(self, token: str) -> int:
        if len(self) > self.most:
            self.clear()
        core = token.strip(PUNCTUATION)
        capital = CAPITAL * (len(core) > 2 and core.isupper())
        if core.isalpha() and token[0] not in "@$" and not (stretch := bool(_stretched.search(core))):
            code = self._code(core.lower()) + capital
        elif not core:
            code = 0
        else:
            inner = _core.sub("", token)
            word, odd, stretch = plain(token), bool(_inside.search(inner)), bool(_stretched.search(token))
            code = self._code(word)
            if (odd or stretch) and not code & FIXED and not code >> SHIFT:
                found = self._code(undone(inner))
                code |= found | HIDDEN * bool(found & FIXED or found >> SHIFT)
            code += ODD * odd + LONG * stretch + capital
        self[token] = code
        return code


def features(text: str | None, facts: TokenFacts) -> list[float]:
    raw = text_bytes(text)
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(raw)
    letters = len(raw.translate(None, NO_LETTERS))
    common = [np.log1p(n), letters / size]
    rates = [(size - len(raw.translate(None, CAPITALS))) / size]
    marks = [raw.count(b"!") / n, (size - len(raw.translate(None, MARKS))) / size]
    code = np.fromiter(map(facts.__getitem__, tokens), np.int64, n)
    code_at = np.flatnonzero(code)
    c = code[code_at]
    if not len(c):
        return [0.0] * 12 + rates + [0.0] + marks + [0.0, 0.0] + common
    kind = c >> SHIFT
    weight = facts.weights[kind]
    hit = ((c & FIXED) > 0) | (kind > 0)
    hits, near = int(hit.sum()), 0
    you = code_at[(c & YOU) > 0]
    if hits and len(you):
        at = code_at[hit]
        near = int((np.searchsorted(you, at + 5, "right") > np.searchsorted(you, at - 5, "left")).sum())
    count = lambda bit: float(((c & bit) > 0).sum())
    fixed, hidden = count(FIXED), count(HIDDEN)
    dense = [fixed, fixed / n, hits, hits / n, weight.sum(), weight.sum() / n, weight.max(), len(np.unique(kind[kind > 0])), near, near / n, hidden, hidden / n]
    return [*dense, *rates, count(CAPITAL) / n, *marks, count(ODD) / n, count(LONG) / n, *common]


def learned_lexicon(units: DataFrame, positive: int, negative: int, most: int = 2000) -> dict[str, float]:
    """Log odds of the `most` units that mark most toxic texts, of those at least 20 times likelier there. units: (unit, p, n), in how
    many toxic and other texts; positive and negative: how many such texts there are."""
    weight = F.log((F.col("p") + 0.1) / (positive + 1)) - F.log((F.col("n") + 0.1) / (negative + 1))
    some = units.where(F.col("p") >= max(2, 0.002 * positive)).withColumn("weight", weight).where("weight >= 3")
    top = some.orderBy(F.desc(F.col("p") * F.col("weight")), "unit").limit(most)  # the lexicon's size is a feature
    return {r["unit"]: r["weight"] for r in top.select("unit", "weight").collect()}


# ------------------------------------------------------------------ trees


class Trees:
    """Gradient-boosted trees for the logistic loss over quantile bins, grown level by level."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        rate = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self.grow(b, w * (p - y), w * p * (1 - p))
            self.trees.append(tree)
            raw += self.rate * self.leaf(tree, b)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        """A full tree: for each inner node feature and bin (right of it goes right), for each leaf its value."""
        node, feature, cut = np.zeros(len(b), np.int64), [], []
        for level in range(self.depth):
            k, width = 1 << level, self.bins + 1
            best, own_f, own_c = np.zeros(k), np.zeros(k, np.int64), np.full(k, width)
            sums = np.bincount(node, g, k), np.bincount(node, h, k)
            whole = sums[0] ** 2 / (sums[1] + self.penalty)
            for f in range(b.shape[1]):
                at = node * width + b[:, f]
                left_g = np.bincount(at, g, k * width).reshape(k, width).cumsum(1)
                left_h = np.bincount(at, h, k * width).reshape(k, width).cumsum(1)
                right_g, right_h = sums[0][:, None] - left_g, sums[1][:, None] - left_h
                gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - whole[:, None]
                gain = np.where((left_h > 0.5) & (right_h > 0.5), gain, 0)
                c = gain.argmax(1)
                top = gain[np.arange(k), c]
                better = top > best + 1e-9
                best, own_f, own_c = np.where(better, top, best), np.where(better, f, own_f), np.where(better, c, own_c)
            feature.append(own_f)
            cut.append(own_c)
            node = 2 * node + (b[np.arange(len(b)), own_f[node]] > own_c[node])
        leaves = 1 << self.depth
        return feature, cut, -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)

    def leaf(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for f, c in zip(feature, cut):
            node = 2 * node + (b[rows, f[node]] > c[node])
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + self.rate * sum(self.leaf(t, b) for t in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (raw, probability), ascending, to interpolate between."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted y, weighted raw
    for r, t, u in zip(raw[order].tolist(), y[order].tolist(), w[order].tolist()):
        blocks.append([u, u * t, u * r])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray], rate: float):
        self.lexicon, self.trees, self.knots, self.rate = lexicon, trees, knots, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the raw one keeps the order within isotonic steps."""
        if self.trees is None:
            return np.full(len(x), self.rate)
        raw = self.trees.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def sample_of(labels: DataFrame, per_class: int) -> DataFrame:
    """labels(doc_id, toxic): per_class rows of each class by the smallest hash, with the half each lies in."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("doc_id", F.lit(3)))
    parts = [known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1]).withColumn("half", F.pmod("h", F.lit(2)).cast("int")).drop("h")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, most: int = 2000) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic). most: units in the learned lexicon."""
    spark = docs.sparkSession
    shares = {r["y"]: r["n"] for r in labels.where("toxic IS NOT NULL").groupBy((F.col("toxic") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    rate = shares.get(1, 0) / total if total else 0.0
    if min(shares.get(0, 0), shares.get(1, 0)) == 0:
        return Model({}, None, (np.zeros(1), np.zeros(1)), rate)
    chosen = written(sample_of(labels, per_class), "toxic-sample")
    # at most 2 * per_class ids, so they can be broadcast
    texts = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "half", "text").repartition("doc_id"), "toxic-texts")

    def frequencies(batches):
        held: list[Counter] = [Counter() for _ in range(4)]
        for b in batches:
            for y, half, text in zip(b["y"], b["half"], b["text"]):
                words = {plain(t) for t in (text or "").split()}
                held[2 * half + y].update({u for w in words if w for u in units(w)})
        for k, c in enumerate(held):
            yield {"unit": list(c), "k": [k] * len(c), "n": list(c.values())}

    counted = map_batches(texts, frequencies, "unit string, k int, n long").groupBy("unit").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    by_unit = written(counted.where("n1 + n3 >= 2"), "toxic-units")
    sizes = {(r["half"], r["y"]): r["n"] for r in texts.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    size = lambda y, *halves: sum(sizes.get((h, y), 0) for h in halves)
    half = lambda h: learned_lexicon(by_unit.select("unit", F.col(f"n{2 * h + 1}").alias("p"), F.col(f"n{2 * h}").alias("n")), size(1, h), size(0, h), most)
    both = learned_lexicon(by_unit.select("unit", F.expr("n1 + n3").alias("p"), F.expr("n0 + n2").alias("n")), size(1, 0, 1), size(0, 0, 1), most)
    sent = Shared(spark, [half(1), half(0)])  # by half: the lexicon of the other

    def dense(batches):
        facts = [TokenFacts(x) for x in sent.get()]
        for b in batches:
            yield {"y": b["y"], "half": b["half"], "x": [[float(v) for v in features(t, facts[h])] for t, h in zip(b["text"], b["half"])]}

    rows = map_batches(texts, dense, "y int, half int, x array<double>").collect()  # at most 2 * per_class short rows
    release(chosen, texts, by_unit)
    if len({r["y"] for r in rows}) < 2:  # labels of documents that are not there
        return Model({}, None, (np.zeros(1), np.zeros(1)), rate)
    x, y, h = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["half"] for r in rows])
    order = np.lexsort((*x.T, y, h))  # the same trees whatever the rows' order
    x, y, h = x[order], y[order], h[order]
    # weights bring the sample back to the rate among all labels
    w = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
    raw = np.zeros(len(y))
    for k in (0, 1):
        if (h == k).any() and (h != k).any():
            raw[h == k] = Trees().fit(x[h != k], y[h != k], w[h != k]).raw(x[h == k])
    return Model(both, Trees().fit(x, y, w), isotonic(raw, y, w), rate)


def score(docs: DataFrame, model: Model, name: str = "score", without: tuple[str, ...] = ("text",)) -> DataFrame:
    """docs(text, ...) with the column `name`, each text's score, beside all other columns but `without`: scored where a text
    is read, without a shuffle."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    sent = Shared(docs.sparkSession, model)
    stay = [f for f in docs.schema.fields if f.name not in without]

    def run(batches):
        m = sent.get()
        facts = TokenFacts(m.lexicon)
        for b in batches:
            x = np.array([features(t, facts) for t in b.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            yield {f.name: b.column(f.name) for f in stay} | {name: m.score(x)}

    return map_arrow(docs, run, T.StructType([*stay, T.StructField(name, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 3) == 1


def learned(docs: DataFrame, labels: DataFrame, **kw) -> Model:
    """The model of docs(doc_id, text) by the labels(doc_id, toxic) of rows that are not held out."""
    return train(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))), **kw)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """Every document's score as doc_id, held_out, score, predicted; the model learned from labels of rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), learned(docs, labels, **kw))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Trees over learned features can't be written in SQL; the tests hold op1 against held-out labels.
ORACLE_SQL = None
