"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Each document is cut into full sequences and one remainder. Pieces are dealt at random into groups of bounded size; each
group packs its pieces alone, so groups run in parallel and none gathers more than its share. Only piece lengths are
shuffled: the checksum of a piece's ids is computed where the text is read.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_count import byte_letters

#: Pieces that one group packs, on average.
GROUP_PIECES = 8192
#: Distinct words of texts that are not plain, and letter runs of these words, whose ids are remembered in one Python worker, and
#: the longest of them.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 48
#: Letter runs that the library encodes in one call, joined by blanks.
JOINED = 256

#: Control characters that Python's split() takes for white space and the tokenizer does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE}]+")
#: A letter run between ASCII marks other than the apostrophe: the vocabulary always cuts between these. (In lower case,
#: U+0130 ends in a mark.)
MARKED = re.compile(r"""([!-&(-/:-@\[-`{-~]*)([^\W\d_]*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f])([!-&(-/:-@\[-`{-~]*)""")
#: How a vocabulary cuts texts so that words and their parts can be encoded one by one.
NORMALIZERS = ("NFC", "Replace", "Lowercase")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The rules of a vocabulary whose plain texts tiktoken can encode.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Plain texts: printable ASCII, composed Latin letters but U+0130, dashes and quotation marks. NFC leaves them as they are, and
#: each character has one in lower case, whatever stands beside it.
PLAIN = re.compile(rf"[!-~\u00ab\u00bb\u00c0-\u012f\u0131-\u017f\u2010-\u2027{SPACE}]*")
#: SPLIT for plain texts in lower case, and the longest part that tiktoken encodes.
PLAIN_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f{SPACE}]+")
PART_CHARS = 255


def part_encoder(spec: dict) -> tiktoken.Encoding | None:
    """tiktoken's encoder of parts that end in a blank, which stands for the end of a word; None for other vocabularies.

    tiktoken merges two neighbours whenever they make an entry, the library only the pair that the entry's merge names. Both
    give the same ids if these follow the merges and each entry, merged alone by the library, becomes itself: before an entry
    is made nothing crosses its ends, so it is made as it is made alone.
    """
    from tokenizers import Tokenizer, models

    vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != PRE_TOKENIZER or {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges")} != MODEL or any(t["normalized"] for t in spec["added_tokens"]):
        return None
    end, letters = MODEL["end_of_word_suffix"], byte_letters()
    blank = {t: t[: -len(end)] + " " if t.endswith(end) else t for t in vocab}
    if sorted(vocab, key=vocab.get) != [*sorted(letters, key=lambda x: vocab.get(x, -1)), *sorted((x + end for x in letters), key=lambda x: vocab.get(x, -1)), *(a + b for a, b in merges)]:
        return None
    entries = [blank[t] for t in sorted(vocab, key=vocab.get)]
    numbers = {t: i for i, t in enumerate([*entries, " "])}
    alone = Tokenizer(models.BPE(vocab=numbers, merges=[*((x, " ") for x in letters), *((blank[a], blank[b]) for a, b in merges)]))
    if any(e.ids != [i] for i, e in enumerate(alone.encode_batch_fast(entries, add_special_tokens=False))):
        return None
    byte = {x: bytes([b]) for b, x in enumerate(letters)} | {" ": b" "}
    return tiktoken.Encoding("parts", pat_str="[^ ]+ ", mergeable_ranks={b"".join(map(byte.get, t)): vocab[k] for k, t in blank.items()}, special_tokens={})


class WordIds:
    """Texts' ids as little-endian unsigned 32-bit bytes: plain texts by tiktoken, of others the library encodes each distinct
    letter run once.

    A vocabulary of the known kind drops white space and none of its rules looks across it, so words are encoded one by
    one; texts of any other vocabulary go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        own = lambda kind, name: [x for x in ((spec[kind] or {}).get(name) or [])]
        cuts = [p.get("pattern", {}).get("Regex") for p in own("pre_tokenizer", "pretokenizers")]
        self.by_word = tuple(x["type"] for x in own("normalizer", "normalizers")) == NORMALIZERS and cuts[:1] == [SPLIT] and spec["model"].get("end_of_word_suffix") == "</w>" and all((m := MARKED.fullmatch(x)) and m[1] and m[3] for x in self.special)
        self.parts = part_encoder(spec) if self.by_word else None
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_runs(self, runs: list[str]) -> None:
        """Remembers the ids of letter runs. Each is one pretoken, whose last id alone ends a word, so the ids of many runs
        in one text fall apart again; if they don't, because the library has other letters, each goes alone."""
        parts = [runs[lo : lo + JOINED] for lo in range(0, len(runs), JOINED)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                data, cuts = ids.tobytes(), (4 * cuts).tolist()
                self.known.update((r, data[a:b]) for r, a, b in zip(part, [0, *cuts], cuts))
            else:
                self.known.update(zip(part, self.library(part), strict=True))

    def learn(self, words: Iterable[str]) -> list[str]:
        """Remembers the ids of words and of their letter runs; returns those too long to be kept. Letters are encoded in
        lower case where that changes nothing else; a word that would hold a special string only then stays as it is, for
        the library looks for these before it lower-cases."""
        known, new, whole, cut = self.known, set(), set(), []
        for w in words:
            if w.isalpha():
                before, run, after = "", w, ""
            elif (m := MARKED.fullmatch(w)) and not (m[1] and m[3] and any(x in w.lower() for x in self.special)):
                before, run, after = m.groups()
                whole.update(x for x in (before, after) if x and x not in known)
            else:
                whole.add(w)
                continue
            if run.isascii():
                run = run.lower()
            if run not in known:
                new.add(run)
            if run is not w:
                cut.append((w, before, run, after))
        self.encode_runs(sorted(new))
        apart = sorted(whole)
        known.update(zip(apart, self.library(apart), strict=True))
        for w, before, run, after in cut:
            ids = known[run]
            if before:
                ids = known[before] + ids
            known[w] = ids + known[after] if after else ids
        return [x for part in (new, whole, [c[0] for c in cut]) for x in part if len(x) > CACHE_CHARS]

    def plain(self, text: str) -> bytes | None:
        """Ids of a plain text without special strings and long parts; None for any other."""
        if self.parts is None or not PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return None
        parts = PLAIN_PARTS.findall(text.lower())
        if len(max(parts, key=len, default="")) > PART_CHARS:
            return None
        return array("I", self.parts.encode_ordinary(" ".join([*parts, ""]))).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.library(texts)
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        out = [self.plain(t) for t in texts]
        split = {i: SPACES.split(t) if any(c in t for c in SEPARATORS) else t.split() for i, t in enumerate(texts) if out[i] is None}
        words: set[str] = set()
        for own in split.values():
            words.update(own)
        words.difference_update(known)
        long = self.learn(words) if words else []
        for i, own in split.items():
            out[i] = b"".join(map(known.__getitem__, own))
        for w in long:
            known.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for a Python worker, with what it remembers from task to task."""
    return WordIds(path)


class TournamentTree:
    """Room left in each bin; the root holds the most room, so the first bin that fits is found in log steps."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.size)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, room before) of the first bin with room for length."""
        most, i = self.most, 1
        while i < self.size:
            i = 2 * i if most[2 * i] >= length else 2 * i + 1
        room, at = most[i], i - self.size
        most[i] = room - length
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return at, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, which must not increase and not exceed the capacity."""
    tree, bins, offsets = TournamentTree(len(lengths), capacity), [], []
    for n in lengths:
        at, room = tree.place(n)
        bins.append(at)
        offsets.append(capacity - room)
    return bins, offsets


def tokenised(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc_tokens, crcs (one for each cut of `capacity` ids), and a salt for the random groups."""
    common.bounded_batches(docs.sparkSession)

    def make():
        encoder, end, step, seen = word_ids(vocabulary), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity, [0]

        def handle(ids, values):
            tokens, crcs, salts = [], [], []
            for doc_id, own in zip(ids, encoder.encode_all(values), strict=True):
                data = memoryview(own + end)
                tokens.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + step]) for i in range(0, len(data), step)])
                seen[0] += 1
                salts.append(zlib.crc32(f"{doc_id} {seen[0]}".encode()))
            return {"doc_id": ids, "doc_tokens": tokens, "crcs": crcs, "salt": salts}

        return handle

    return common.map_texts(docs, make, "doc_id long, doc_tokens long, crcs array<long>, salt long", id_col, text_col)


def pack_pieces(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows (doc_id, start, length, ids_crc32, doc_tokens, salt)."""
    groups = max(1, math.ceil(pieces.count() / group_pieces))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        first = int(pdf["part"].iloc[0]) << 32
        return pdf.drop(columns=["part"]).assign(sequence_id=[first + b for b in bins], offset=offsets)

    part = F.pmod(F.xxhash64("salt", "start"), F.lit(groups)).alias("part")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", part).groupBy("part").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: path of the tokenizer's .json file, present on every executor. Every document ends in end_id, so a null
    or empty text is one piece of one id. A text longer than the capacity fills whole sequences and its rest is packed.
    Repeated rows are packed each on its own; an empty table gives no rows; other columns are ignored.
    """
    cut = common.saved(tokenised(docs, vocabulary, end_id, capacity, id_col, text_col), "packing")
    pieces = cut.select("doc_id", "doc_tokens", "salt", F.posexplode("crcs").alias("k", "ids_crc32"))
    start = F.col("k").cast("long") * capacity
    pieces = pieces.select("doc_id", start.alias("start"), F.least(F.lit(capacity), F.col("doc_tokens") - start).cast("long").alias("length"), "ids_crc32", "doc_tokens", "salt")
    return pack_pieces(pieces, capacity, group_pieces)
