"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its initial byte symbols minus the merges made; no identifiers are emitted. Special strings of the
vocabulary that stand in a text count as one token each, as the tokenizer library's default does.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from . import common

#: The vocabulary's split of a text into pretokens (fixed value; white space as the Unicode property).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: White space that isn't a single space or line feed between two words: such texts are split by the pattern alone.
UNEVEN = re.compile(r"\A\s|\s\Z|\s\s|[^\S \n]|[\x1c-\x1f]")

#: Entries of each memory of one Python worker, and the longest of them.
CACHE_ENTRIES = 800_000
CACHE_CHARS = 48


def remember(known: dict[str, int], key: str, value: int) -> int:
    if len(key) <= CACHE_CHARS:
        if len(known) >= CACHE_ENTRIES:
            known.clear()
        known[key] = value
    return value


def byte_letters() -> list[str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Merge ranks of a byte-level vocabulary and the count of what is left of a pretoken."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["model"].get("end_of_word_suffix") or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level vocabularies without a normaliser, with the usual split and no added first space are counted")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.letters = byte_letters()
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.pretokens: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def pretoken(self, text: str) -> int:
        """Symbols left when no adjacent pair has a rank: the lowest rank merges first, the leftmost of equal ones."""
        symbols = [self.letters[b] for b in text.encode()]
        n = len(symbols)
        if n < 2:
            return n
        rank, after, before = self.rank, [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue  # one of the two has merged meanwhile
            merges += 1
            symbols[i], symbols[j] = a + b, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((a + b, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, a + b, symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((symbols[h], a + b))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], a + b))
        return n - merges

    def pattern(self, text: str) -> int:
        """Symbols left of all pretokens of a text."""
        known, total = self.pretokens, 0
        for w in self.split.findall(text):
            n = known.get(w)
            if n is None:
                n = remember(known, w, self.pretoken(w))
            total += n
        return total

    def words(self, known: dict[str, int], lead: str, words: list[str]) -> int:
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            return sum(n if (n := known.get(w)) is not None else remember(known, w, self.pattern(lead + w)) for w in words)

    def plain(self, text: str) -> int:
        """No pretoken holds a space but at its start, and a line feed between two words stands alone."""
        if not text or UNEVEN.search(text):
            return self.pattern(text)
        total = text.count("\n")
        for line in text.split("\n"):
            words = line.split(" ")
            total += self.words(self.first, "", words[:1]) + self.words(self.spaced, " ", words[1:])
        return total

    def count(self, text: str) -> int:
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return sum(1 if i % 2 else self.plain(part) for i, part in enumerate(self.cut.split(text)))


@lru_cache(maxsize=1)
def merger_of(path: str) -> PairMerger:
    """One for a Python worker, with what it remembers from task to task."""
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    vocabulary: path of a byte-level BPE .json file, present on every executor. A null or empty text has 0 bytes and 0
    tokens; repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """

    def make():
        merger = merger_of(vocabulary)

        def handle(ids, values):
            counts = [merger.count(t) for t in values]
            return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in values], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return handle

    return common.map_texts(docs, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", id_col, text_col)
