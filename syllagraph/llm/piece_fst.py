"""SentencePiece encoding and decoding with weighted finite-state transducers over the tropical semiring (min, +).

Three machines are compiled from a model file as arc tables and composed with each input:

* Normaliser: from the start state an arc without input writes the added first blank mark; then one state copies every
  character but writes the blank mark for a blank.
* Pieces: a trie with one arc per character; where a piece ends, an arc back to the start writes its identifier. Its weight
  is minus the piece's score in a unigram model and 0 in a byte-pair model.
* Byte fallback: a character without a piece of its own goes through one arc per UTF-8 byte; in a unigram model the first
  arc weighs as much as the library's unknown character.

A byte-pair model has one machine more, whose states are pieces: going from one piece to the next weighs 0 if merging by
score would leave the two side by side, and infinitely much if it would join across them. So of all paths through the
composition, those of finite weight spell the library's segmentation. A pair's weight follows from the pieces' merge trees
alone: a part on the right edge of the left tree and one on the left edge of the right tree would merge if their join is a
piece that comes before each one's own merge into its tree.

The composition is made state by state while the path is sought; it has no cycle, so distances are relaxed in the order of
the input's places. Nothing spans two units (words with the blanks before them), so equal units are composed once.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

BLANK = "▁"
#: Kinds of models and of pieces in a model file, and what an unknown character costs above the dearest piece.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0

CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
#: Key in a trie state of the piece that ends there.
END = ""
#: A character without a piece is symbol LONE + its code point in the machine of pairs.
LONE = 1 << 21


class PieceTransducer:
    """Machines of a byte-pair or unigram SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as model

        spec = model.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normaliser, kind = spec.normalizer_spec, spec.trainer_spec.model_type
        kinds = {p.type for p in spec.pieces}
        if kind not in (UNIGRAM, BPE) or normaliser.precompiled_charsmap or normaliser.remove_extra_whitespaces or not normaliser.escape_whitespaces or kinds & {USER, UNUSED} or not spec.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair and unigram models with byte fallback, without a charsmap, removed blanks, and user or unused pieces are compiled")
        self.surfaces = [p.piece if p.type == NORMAL else "" for p in spec.pieces]
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("pieces with a blank mark after other characters are not compiled")
        self.paired = kind == BPE
        # normaliser: by state, what the arc without input writes on the way to the last state, and that one's arcs other
        # than copies
        table = {ord(" "): BLANK}
        self.normaliser = [(BLANK if normaliser.add_dummy_prefix else "", table), ("", table)]
        self.prefix = normaliser.add_dummy_prefix
        # byte fallback: symbol of each byte's arc
        self.byte_ids = [next(i for i, p in enumerate(spec.pieces) if p.type == BYTE and p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.fallback = 0.0 if self.paired else UNKNOWN_PENALTY - min(self.score.values(), default=0.0)
        # pieces: the trie, and their weights, if they have any
        self.edges: tuple[dict, dict] = ({}, {})
        self.trees: dict[str, tuple[str, str] | None] = {}
        self.weight = [] if self.paired else [-p.score for p in spec.pieces]
        if any(self.score[p] > 0 for p in self.score) and not self.paired:
            raise ValueError("scores of a unigram model are logarithms of probabilities")
        self.trie: dict = {}
        for i, p in enumerate(spec.pieces):
            if p.type == NORMAL and p.piece and (not self.paired or len(p.piece) == 1 or self.tree(p.piece)):
                state = self.trie
                for c in p.piece:
                    state = state.setdefault(c, {})
                state[END] = i
        if self.paired and any(own and any(len(x) > 1 and self.score[p] > self.score[x] for x in own) for p, own in self.trees.items()):
            raise ValueError("a piece must have no higher score than the longer pieces it is merged from")
        # characters that stand side by side in no piece are never joined: a text can be cut between them
        self.neighbours = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        joined = {c for p in self.score if len(p) > 1 for c in p}
        alone = {c for c in map(chr, [*range(33), 127, 0x85, 0xA0]) if c not in joined and c != " "}
        apart = "".join(map(re.escape, sorted(alone)))
        # marks that stand after a letter in no piece: a word ends before one
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and not any(p[1] == c and p[0].isalpha() for p in self.neighbours))
        blank, other = f"[ {BLANK}]", f"[^ {BLANK}{apart}]"
        self.unit = re.compile((f"[{apart}]|" if apart else "") + (f"{blank}*[^\\W\\d_]+(?=[{marks}]|(?!{other}))|" if marks else "") + f"{blank}*{other}+|{blank}+")
        self.pairs: dict[int, dict[int, float]] = {}
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # decoding: what each identifier writes
        self.written = [p.piece.replace(BLANK, " ") if p.type == NORMAL else "" if p.type == CONTROL else spec.trainer_spec.unk_surface for p in spec.pieces]

    # machine of pairs

    def tree(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece of its own characters, or None if merging doesn't make it whole."""
        if piece not in self.trees:
            symbols: list[tuple[str, tuple[str, str] | None]] = [(c, None) for c in piece]
            while len(symbols) > 1:
                joins = [(-self.score[s], i) for i in range(len(symbols) - 1) if (s := symbols[i][0] + symbols[i + 1][0]) in self.score]
                if not joins:
                    break
                _, i = min(joins)
                a, b = symbols[i][0], symbols[i + 1][0]
                symbols[i : i + 2] = [(a + b, (a, b))]
            self.trees[piece] = symbols[0][1] if len(symbols) == 1 else None
        return self.trees[piece]

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """(part, when it is made, when it merges on) along one edge of the piece's tree, by falling merge score."""
        if (known := self.edges[side].get(piece)) is not None:
            return known
        out, until = self.edges[side].setdefault(piece, []), math.inf
        while True:
            own = self.tree(piece) if len(piece) > 1 else None
            made = -self.score[piece] if own else -math.inf
            out.append((piece, made, until))
            if not own:
                return out
            piece, until = own[side], made

    def crosses(self, left: str, right: str) -> bool:
        """Whether a merge would join an edge part of the left piece with one of the right piece. Of equal scores the
        leftmost merge comes first."""
        score, edges = self.score, self.edge(right, 0)
        for x, made_x, until_x in self.edge(left, 1):
            for y, made_y, until_y in edges:
                if (s := score.get(x + y)) is not None and made_x <= -s >= made_y and -s < until_x and -s <= until_y:
                    return True
        return False

    def pair(self, left: int, right: int) -> float:
        """Weight of going from one symbol to the next."""
        text = lambda s: chr(s - LONE) if s >= LONE else self.surfaces[s]
        weight = math.inf if self.paired and left >= 0 and self.crosses(text(left), text(right)) else 0.0
        self.pairs[left][right] = weight
        self.n_pairs += 1
        return weight

    # composition and shortest path

    def normalised(self, text: str, at: int) -> str:
        """What the normaliser writes for a text that it reads from this state on, up to its last state."""
        first, table = self.normaliser[at]
        return first + text.translate(table)

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(place after it, symbol) of all that the machines of pieces and bytes read from a place of a text, short pieces
        first. A character without a piece has its own symbol, with one arc per byte."""
        c, rest = text[at], iter(text[at + 1 :])
        state = self.trie.get(c)
        out = [(at + 1, LONE + ord(c))] if state is None or END not in state else []
        while state is not None:
            at += 1
            if END in state:
                out.append((at, state[END]))
            state = state.get(next(rest, None))
        return out

    def shortest_path(self, text: str) -> list[int]:
        """Identifiers along the path of least weight through the machines composed with a normalised text.

        The composition's states are (place, last symbol), made when the search reaches them. They are settled by rising
        distance, of equal ones the last found first, and an arc's weight is added when its turn comes: arcs of no weight
        keep the search at its distance, others wait in a heap, those of infinite weight lead nowhere.
        """
        n, pairs, weights = len(text), self.pairs, self.weight
        if not n:
            return []
        if self.n_pairs >= 4 * CACHE_ENTRIES:
            pairs.clear()
            self.n_pairs = 0
        ahead: list[list[tuple[int, int]] | None] = [None] * n
        settled: set[int] = set()
        waiting: list[tuple[float, int, tuple]] = []
        count, least, at = 0, 0.0, 0
        state: tuple = (-1, None)  # last symbol, state before
        stack: list[tuple] = []
        while at < n:
            after = pairs.get(state[0])
            if after is None:
                after = pairs[state[0]] = {}
            arcs = ahead[at]
            if arcs is None:
                arcs = ahead[at] = self.arcs(text, at)
            stack.append((arcs.copy(), state, after))
            while True:
                if not stack:
                    least, _, at, state = heapq.heappop(waiting)
                elif not stack[-1][0]:
                    stack.pop()
                    continue
                else:
                    options, before, after = stack[-1]
                    at, symbol = options.pop()
                    state = (symbol, before)
                    weight = after.get(symbol)
                    if weight is None:
                        weight = self.pair(before[0], symbol)
                    if weights:
                        weight += weights[symbol] if symbol < LONE else self.fallback
                    if weight:
                        if weight < math.inf:
                            count += 1
                            heapq.heappush(waiting, (least + weight, count, at, state))
                        continue
                key = at << 22 | state[0]
                if key not in settled:
                    settled.add(key)
                    break
        symbols = []
        while state[1] is not None:
            symbols.append(state[0])
            state = state[1]
        symbols.reverse()
        if max(symbols) < LONE:
            return symbols
        return [x for s in symbols for x in ([s] if s < LONE else [self.byte_ids[b] for b in chr(s - LONE).encode()])]

    def cut(self, text: str) -> list[str]:
        out, lo, neighbours = [], 0, self.neighbours
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in neighbours:
                out.append(text[lo:i])
                lo = i
        return [*out, text[lo:]]

    def remember(self, known: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) <= CACHE_CHARS:
            if len(known) >= CACHE_ENTRIES:
                known.clear()
            known[key] = ids
        return ids

    def unit_ids(self, unit: str, at: int = 1) -> bytes:
        """Identifiers of a unit that the normaliser reads from this state on, as 32-bit integers."""
        text = self.normalised(unit, at)
        if unit.lstrip(" ").isalpha():
            ids = array("i", self.shortest_path(text)).tobytes()
        else:
            ids = b"".join([own if (own := self.parts.get(part)) is not None else self.remember(self.parts, part, array("i", self.shortest_path(part)).tobytes()) for part in self.cut(text)])
        return self.remember(self.known if at else self.first, unit, ids)

    def encoded(self, text: str) -> bytes:
        """Identifiers of a text as 32-bit integers."""
        if not text:
            return b""
        units = self.unit.findall(text)
        first = self.first.get(units[0])
        if first is None:
            first = self.unit_ids(units[0], 0)
        known = self.known
        try:
            return first + b"".join(map(known.__getitem__, units[1:]))
        except KeyError:
            return first + b"".join([own if (own := known.get(u)) is not None else self.unit_ids(u) for u in units[1:]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), dtype=np.int32).tolist()

    # decoding

    def spell(self, ids: list[int]) -> str:
        """What identifiers write in order, runs of byte pieces read as UTF-8."""
        written, raw = self.written, self.bytes_of
        if raw.keys().isdisjoint(ids):
            return "".join(map(written.__getitem__, ids))
        out, held = [], b""
        for i in ids:
            b = raw.get(i)
            if b is not None:
                held += b
                continue
            if held:
                out.append(read_bytes(held))
                held = b""
            out.append(written[i])
        return "".join(out) + read_bytes(held)

    def decode(self, ids: list[int]) -> str:
        """The text of identifiers, the added first blank left out."""
        text = self.spell(ids)
        first = next((i for i in ids if i in self.bytes_of or self.written[i]), None)
        return text[1:] if self.prefix and first is not None and self.surfaces[first] and text.startswith(" ") else text


def read_bytes(data: bytes) -> str:
    """UTF-8 with the replacement character for each byte that fits in no character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


@lru_cache(maxsize=1)
def transducer(path: str) -> PieceTransducer:
    """One for a Python worker, with what it remembers from task to task."""
    return PieceTransducer(path)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, decoded (the text of these ids) of every row's whole text.

    model: path of a SentencePiece model, present on every executor. A null or empty text has no ids and an empty decoded
    text. A blank mark in a text is decoded as a blank. Repeated rows give repeated results; an empty table gives no rows;
    other columns are ignored.
    """

    def make():
        pieces = transducer(model)

        def handle(ids, values):
            found = [pieces.encoded(t) for t in values]
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            flat = np.frombuffer(b"".join(found), dtype=np.int32)
            decoded = [pieces.decode(flat[a:b].tolist()) for a, b in zip(ends, ends[1:])]
            return {"doc_id": ids, "n_ids": np.diff(ends).tolist(), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "decoded": decoded}

        return handle

    return common.map_texts(docs, make, "doc_id long, n_ids long, ids array<int>, decoded string", id_col, text_col)
