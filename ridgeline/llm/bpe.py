"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A batch's texts are cut into words by the vocabulary's pattern; words not met before are encoded together. Their
symbols lie in one flat array. A round packs each neighbouring pair of a word into a key, finds its rank by binary
search over the sorted pair keys, takes each word's lowest rank, and merges all its places from left to right; words
without a known pair leave the array. Rounds go on until it is empty. Encoded words are kept in a bounded store.

Special tokens found in a text become their own ids, as the tokenizers library does by default.

Cases: a null or empty text has no ids and decodes to an empty text. Bytes that are no UTF-8 decode to U+FFFD. Repeated
rows are encoded each; extra columns are left behind, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, documents, map_batches

# Fixed value: the pattern that cuts text before the merges, as published with this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Sorted pair keys with rank and merged id, ids of bytes, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for word, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.of_byte = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)


def merge_rounds(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after another, and how many each word has."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    sym, word = voc.of_byte[flat], np.repeat(np.arange(len(words)), lengths)
    done_sym, done_word, none = [], [], len(voc.ranks)
    while len(sym):
        rank = np.full(len(sym), none, np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        key = sym[inner] << 32 | sym[inner + 1]
        at = np.minimum(np.searchsorted(voc.keys, key), none - 1)
        rank[inner] = np.where(voc.keys[at] == key, voc.ranks[at], none)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(starts, len(sym)))
        least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
        over = least == none
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
        pick = np.flatnonzero((rank == least) & ~over)
        # in a run of overlapping places (a pair of equal symbols) every second one merges, from the left
        first = np.concatenate([[True], np.diff(pick) > 1])[: len(pick)]
        run = np.maximum.accumulate(np.where(first, np.arange(len(pick)), 0))
        pick = pick[(np.arange(len(pick)) - run) % 2 == 0]
        stay = ~over
        sym[pick] = voc.merged[rank[pick]]
        stay[pick + 1] = False
        sym, word = sym[stay], word[stay]
    sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=len(words))


class Coder:
    """Encodes batches of texts; keeps up to `most` encoded words."""

    def __init__(self, voc: Vocabulary, most: int = 200_000):
        self.voc, self.most = voc, most
        self.cut = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(voc.special, key=len, reverse=True))) + ")") if voc.special else None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        special = self.voc.special
        plain = [w.encode("utf-8", "surrogatepass") if w not in special else b"" for w in new]
        ids, sizes = merge_rounds(self.voc, plain)
        if special and any(w in special for w in new):
            at = np.cumsum(sizes) - sizes
            where = [k for k, w in enumerate(new) if w in special]
            ids = np.insert(ids, at[where], [special[new[k]] for k in where])
            sizes[where] = 1
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.pool = np.concatenate([self.pool, ids])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))

    def words(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.voc.special):
            return self.cut(text)
        out: list[str] = []
        for part in self.special.split(text):
            if part in self.voc.special:
                out.append(part)
            else:
                out += self.cut(part)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.index) > self.most:
            self.clear()
        new = list({w for ws in cut for w in ws}.difference(self.index))
        if new:
            self._learn(new)
        get, out = self.index.__getitem__, []
        for ws in cut:
            at = np.fromiter(map(get, ws), np.int64, len(ws))
            size = self.size[at]
            end = np.cumsum(size)
            total = int(end[-1]) if len(end) else 0
            out.append(self.pool[np.repeat(self.start[at] - (end - size), size) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.voc.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = True, at_once: int = 250) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_tokens, ids (if asked for), ids_sha256, decoded, decoded_sha256; ids are decoded again."""
    voc = Shared(docs.sparkSession, Vocabulary(vocabulary))

    def run(batches):
        coder = Coder(voc.get())
        for b in batches:
            for a in range(0, len(b["text"]), at_once):
                ids = coder.encode(b["text"][a : a + at_once])
                back = [coder.decode(x) for x in ids]
                out = {"doc_id": b["doc_id"][a : a + at_once], "n_tokens": [len(x) for x in ids]}
                if keep_ids:
                    out |= {"ids": [x.astype(np.int32) for x in ids], "decoded": back}
                yield out | {
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                }

    extra = "ids array<int>, decoded string, " if keep_ids else ""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, n_tokens long, {extra}ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir, "doc_id", "text"), default_vocabulary(), keep_ids=False)


#: BPE merges can't be written in SQL; the tests hold op7 against the tokenizers library.
ORACLE_SQL = None
