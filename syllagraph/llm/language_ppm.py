"""Language of texts by prediction by partial matching: one byte context tree per language, exact code lengths.

A tree holds how often each byte followed each context of up to ORDER bytes; contexts that were hardly seen are left out, so
the order varies from place to place. A byte is coded in the longest context of its tree that stands before it; a byte that
never followed a context costs an escape to the next shorter one, where the bytes of the longer one are no longer counted.
The statistics stay as learned. The language whose tree codes a text shortest is predicted.

As the bytes seen after a context were also seen after its shorter ones, what an escape leaves out is fixed by the context
escaped from, so the trees are arrays, and a batch of texts is scored by looking its byte grams up level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Longest context in bytes.
ORDER = 4
#: Characters of text of each language that its tree is learned from, about: whole texts by a hash, and some texts at least.
TRAIN_CHARS = 600_000
TRAIN_TEXTS = 60
#: Grams of three bytes and more count from this many occurrences on.
LEAST = 2
#: Bytes that are looked up together.
BLOCK = 1 << 18
#: Remainder of crc32(doc_id) by this is 0 in rows that nothing is learned from.
FOLDS = 5
UNKNOWN = "und"

ASCII_LETTER = re.compile(rb"[A-Za-z]")
LETTER = regex.compile(r"\p{L}")


def held_out(doc_id) -> Column:
    """Whether nothing is learned from the row; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def gram_keys(data: np.ndarray, size: int) -> np.ndarray:
    """The grams of so many bytes that end at each place, as numbers; the first size - 1 places have none."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for i in range(size):
        out = (out << 8) | data[i : i + n]
    return out


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text of different texts of each language, by a hash of the text: a sample that only fits the trees."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("texts"))
    span = 1 << 30
    share = F.greatest(F.lit(TRAIN_CHARS) / F.greatest("chars", F.lit(1)), F.lit(TRAIN_TEXTS) / F.col("texts"))
    sizes = sizes.select("lang", F.least(F.lit(span), F.ceil(share * span)).alias("below"))
    # one row per language
    return rows.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("text"), F.lit(span)) < F.col("below")).select("lang", "text").distinct()


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, size, gram, n: byte grams of up to ORDER + 1 bytes and how often they occur, those too rare left out."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                for size in range(1, ORDER + 2):
                    grams, n = np.unique(gram_keys(data, size), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([size] * len(grams), pa.int32()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "size", "gram", "n"])

    counted = texts.mapInArrow(run, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("size") <= 2) | (F.col("n") >= LEAST))


class ContextTrees:
    """The trees of all languages over one numbering of their grams.

    grams[k] are the sorted k-byte grams of any tree; seen[k][i, l] how often gram i occurs in language l. As contexts, gram
    i of k bytes has in language l: total and kinds of the bytes that followed it, and what is left of its shorter context
    after an escape from it. Place len(grams[k]) of every table stands for no gram.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, size: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.grams = [np.zeros(1, np.int64)] + [np.unique(gram[size == k]) for k in range(1, ORDER + 2)]
        self.symbol = np.full(256, len(self.grams[1]), np.int64)
        self.symbol[self.grams[1]] = np.arange(len(self.grams[1]))
        seen = []
        for k, keys in enumerate(self.grams):
            own = size == k
            table = np.zeros((len(keys) + 1, len(langs)))
            table[np.searchsorted(keys, gram[own]), lang[own]] = n[own]
            seen.append(table)
        self.child, total, kinds, left = [], [], [], [None]
        for k in range(ORDER + 1):
            longer, followed = self.grams[k + 1], seen[k + 1][:-1]
            before = np.searchsorted(self.grams[k], longer >> 8) if k else np.zeros(len(longer), np.int64)
            total.append(self.added(before, followed, k))
            kinds.append(self.added(before, followed > 0, k))
            step = np.full((len(self.grams[k]) + 1, len(self.grams[1]) + 1), len(longer), np.int32)
            step[before, self.symbol[longer & 255]] = np.arange(len(longer))
            self.child.append(step.ravel())
            if k:
                parent = np.append(self.place(self.grams[k], k - 1), len(self.grams[k - 1]))
                behind = self.place(longer, k)
                gone = self.added(before, np.where(followed > 0, seen[k][behind], 0), k)
                new = kinds[k - 1][parent] - kinds[k]
                left.append((total[k - 1][parent] - gone + new, new))
        with np.errstate(divide="ignore"):
            self.bits = [np.log2(x).astype(np.float32) for x in seen]
            self.has = [x > 0 for x in seen]
            self.node = [x > 0 for x in total]
            self.start = [np.log2(t + d).astype(np.float32) for t, d in zip(total, kinds, strict=True)]
            self.escape = [np.log2(d).astype(np.float32) for d in kinds]
            certain = lambda x: np.where(x > 0, np.log2(np.maximum(x, 1)), 0).astype(np.float32)
            self.left = [None] + [(np.where(new > 0, certain(rest), 0).astype(np.float32), certain(new)) for rest, new in left[1:]]
        self.unseen = np.log2(np.maximum(256 - kinds[0][0], 1)).astype(np.float32)
        full = self.grams[ORDER + 1]
        chain = [self.place(full, k) for k in range(1, ORDER + 1)] + [np.arange(len(full))]
        contexts = [np.zeros(len(full), np.int64)] + [self.place(full >> 8, k) for k in range(1, ORDER + 1)]
        self.cost = self.code_lengths(contexts, chain)

    def added(self, at: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Sums of the rows by place, and a row of zeros for no gram."""
        out = np.zeros((len(self.grams[k]) + 1, rows.shape[1]))
        np.add.at(out, at, rows)
        return out

    def place(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Places of the last k bytes of grams that are known to be there."""
        return np.searchsorted(self.grams[k], keys & ((1 << 8 * k) - 1))

    def code_lengths(self, contexts: list[np.ndarray], chain: list[np.ndarray]) -> np.ndarray:
        """Bits of each byte in each language: contexts[k] are the places of the k bytes before it, chain[k] of the k + 1 bytes
        that end with it."""
        shape = (len(chain[0]), len(self.langs))
        bits, entered, coded = np.zeros(shape, np.float32), np.zeros(shape, bool), np.zeros(shape, bool)
        for k in range(ORDER, -1, -1):
            at, gram = contexts[k], chain[k]
            live = self.node[k][at] & ~coded
            total, escape = self.start[k][at], self.escape[k][at]
            if k < ORDER:
                rest, new = (x[contexts[k + 1]] for x in self.left[k + 1])
                total, escape = np.where(entered, rest, total), np.where(entered, new, escape)
            hit = live & self.has[k + 1][gram]
            bits += np.where(hit, total - np.where(hit, self.bits[k + 1][gram], 0), np.where(live, total - np.where(live, escape, 0), 0))
            coded |= hit
            entered |= live
        return np.where(coded, bits, bits + self.unseen)

    def scored(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text in each language; starts are the places of the texts' first bytes in data, no text is empty."""
        out = np.zeros((len(starts), len(self.langs)))
        for lo in range(0, len(data), BLOCK):
            hi, back = min(lo + BLOCK, len(data)), max(lo - ORDER, 0)
            first, last = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
            out[first:last] += self.block(data[back:hi], lo - back, starts[first:last] - back)
        return out

    def block(self, data: np.ndarray, skip: int, starts: np.ndarray) -> np.ndarray:
        """Bits of the texts of a block, whose first bytes only stand before it."""
        symbols = self.symbol[data]
        width = len(self.grams[1]) + 1
        chain = [np.where(symbols < width - 1, symbols, len(self.grams[1])).astype(np.int32)]
        own = starts[starts >= 0]
        for k in range(1, ORDER + 1):
            none = len(self.grams[k + 1])
            ids = np.empty(len(data), np.int32)
            ids[0] = none
            np.take(self.child[k], chain[-1][:-1].astype(np.int64) * width + symbols[1:], out=ids[1:])
            inside = own[:, None] + np.arange(k)
            ids[inside[inside < len(data)]] = none
            chain.append(ids)
        full = chain[ORDER][skip:]
        bits = self.cost[np.minimum(full, len(self.cost) - 1)] if len(self.cost) else np.zeros((len(full), len(self.langs)), np.float32)
        rare = np.flatnonzero(full == len(self.grams[ORDER + 1])) + skip
        contexts = [np.zeros(len(rare), np.int64)]
        for k in range(1, ORDER + 1):
            before = chain[k - 1][np.maximum(rare - 1, 0)]
            at_start = np.isin(rare, own) | (rare == 0)
            contexts.append(np.where(at_start, len(self.grams[k]), before))
        bits[rare - skip] = self.code_lengths(contexts, [c[rare] for c in chain])
        return np.add.reduceat(bits, np.maximum(starts - skip, 0), axis=0, dtype=np.float64)


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ContextTrees | None:
    """The trees of all languages of rows that aren't held out; None if there is no such row with a text."""
    counts = gram_counts(training_texts(docs, id_col, text_col, lang_col)).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    return ContextTrees(langs, np.array([number[x] for x in names]), *(counts.column(c).to_numpy() for c in ("size", "gram", "n")))


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or bool(not text.isascii() and LETTER.search(text.decode()))


def predicted(trees: ContextTrees, values: list[str]) -> tuple[list[str], list[float], list[float | None]]:
    """Language, share of it among all languages at equal odds, and bits a byte of each text."""
    raw = [t.encode() for t in values]
    spoken = [i for i, t in enumerate(raw) if has_letter(t)]
    langs, scores, rates = [UNKNOWN] * len(raw), [0.0] * len(raw), [None] * len(raw)
    if spoken:
        sizes = np.array([len(raw[i]) for i in spoken])
        bits = trees.scored(np.frombuffer(b"".join([raw[i] for i in spoken]), np.uint8), np.cumsum(sizes) - sizes)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        for i, b, s, r in zip(spoken, best.tolist(), share.tolist(), (least / sizes).tolist(), strict=True):
            langs[i], scores[i], rates[i] = trees.langs[b], s, r
    return langs, scores, rates


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte of every row.

    The trees are learned from rows with a language whose crc32(doc_id) mod 5 isn't 0, about TRAIN_CHARS characters of each
    language; they are as large as that sample, not as the table. A null text and one without a letter is "und" with score 0
    and no bits, as is every text if nothing can be learned. Of languages with equal code lengths the first by name is taken.
    Repeated rows give repeated results; a null id counts as held out; no rows give no rows; other columns are ignored.
    """
    trees = learn_languages(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def make():
        trees = shared.value

        def handle(ids, values):
            langs, scores, rates = predicted(trees, values) if trees else ([UNKNOWN] * len(ids), [0.0] * len(ids), [None] * len(ids))
            return {"doc_id": ids, "lang_pred": langs, "score": scores, "bits_per_byte": rates}

        return handle

    rows = common.map_texts(docs, make, "doc_id long, lang_pred string, score double, bits_per_byte double", id_col, text_col)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
