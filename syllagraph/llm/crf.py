"""Conditional random fields over the tokens of a text, with numpy: features, training, and exact or loopy decoding.

A token's features depend on its shape, on a context that the caller may give it and, for words of a small learned lexicon,
on the word. Weights are per feature and distance, so a token's score is a sum over its neighbours of table rows: a batch of
texts is scored by a few array look-ups. Label 0 is always "outside"; texts are taken to stand between two outside tokens.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from dataclasses import dataclass, field

import numpy as np

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Distances of the neighbours whose features count; PAD rows stand between texts.
REACH = 3
OFFSETS = range(-REACH, REACH + 1)
#: Words of the lexicon at most, and the texts that each must come from.
LEXICON_WORDS = 400
LEAST_TEXTS = 6
CACHE_ENTRIES = 200_000
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Score of what a token known to have another label can't be.
NEVER = -1e4


def shape(token: str) -> tuple:
    """What of a token its features see: kind of letters, length bucket, how often letters and digits take turns."""
    n = len(token)
    if token.isalpha():
        case = 0 if token.islower() else 1 if token.isupper() else 2
        return ("alpha", case, min(n, 24) // 4)
    if n == 1:
        return ("mark", token if token.isascii() else "?", 1)
    if token.isdigit():
        return ("digits", min(n, 24), 0)
    if not token.isascii():
        return ("mixed", 0, min(n, 60) // 4)
    return ("mixed", (2 if HEX.fullmatch(token) else 1, min(len(TURN.findall(token)), 7) // 2), min(n, 60) // 4)


def features_of(key: tuple, word: str | None, context: str) -> list[str]:
    kind, detail, size = key
    out = [f"k={kind}", f"k={kind},{detail}", f"k={kind},{size}", f"k={kind},{detail},{size}"]
    if word:
        out.append(f"w={word}")
    return out + [f"c={context}", f"c={context},{size}"] if context else out


def file_class(text: str) -> int:
    """Bucket of a text's own features: share of digits, assignments, and code-like marks."""
    n = len(text) or 1
    digits = sum(map(text.count, "0123456789")) / n
    return (0 if digits == 0 else 1 if digits < 0.01 else 2 if digits < 0.05 else 3) + 4 * ("=" in text) + 8 * ("{" in text or ";" in text or "|" in text)


FILE_CLASSES = 16


@dataclass
class Field:
    """A trained field. table[d][r]: label scores that a token of row r gives the token at distance d."""

    labels: int
    lexicon: dict[str, int]
    weights: dict[str, int]  # place of each feature
    values: np.ndarray  # distances x features x labels
    files: np.ndarray  # file classes x labels
    chain: np.ndarray  # labels x labels
    skips: tuple[np.ndarray, ...] | None = None  # scores of label pairs of linked tokens, for each kind of link
    sure: np.ndarray | None = None  # least mean belief of an added span of each label
    rows: dict = field(default_factory=dict)
    table: np.ndarray | None = None
    cache: dict = field(default_factory=dict)

    def row(self, token: str, context: str = "") -> int:
        """Place of a token's row in the table; row 0 is the padding."""
        word = low if (low := token.lower()) in self.lexicon else None
        key = (shape(token), word, context)
        at = self.rows.get(key)
        if at is None:
            own = [self.weights[f] for f in features_of(*key) if f in self.weights]
            new = self.values[:, own].sum(axis=1, dtype=np.float64)[:, None].astype(np.float32)
            if self.table is None:
                pad = self.values[:, [self.weights["pad"]]].astype(np.float32)
                self.table, self.rows["pad"] = pad, 0
            at = self.rows[key] = self.table.shape[1]
            self.table = np.concatenate([self.table, new], axis=1)
        if len(token) <= 64:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[(token, context) if context else token] = at
        return at

    def rows_of(self, tokens: list[str], contexts: dict[int, str]) -> list[int]:
        cache = self.cache
        try:
            out = list(map(cache.__getitem__, tokens))
        except KeyError:
            out = [at if (at := cache.get(t)) is not None else self.row(t) for t in tokens]
        for i, c in contexts.items():
            at = cache.get((tokens[i], c))
            out[i] = self.row(tokens[i], c) if at is None else at
        return out

    def scores(self, texts: list[str], tokens: list[list[str]], contexts: list[dict[int, str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all tokens with REACH padding rows before, between and after the texts; each text's first place.
        contexts: of each text, those of some of its tokens."""
        flat, starts, files = [0] * REACH, [], []
        for text, own, known in zip(texts, tokens, contexts or [{}] * len(texts), strict=True):
            starts.append(len(flat))
            flat += self.rows_of(own, known)
            flat += [0] * REACH
            files.append(file_class(text))
        at = np.array(flat, dtype=np.int32)
        out = np.zeros((len(at), self.labels), dtype=np.float32)
        if self.table is not None:
            for k, d in enumerate(OFFSETS):
                part = self.table[k][at]  # what each token gives the one at distance -d
                if d < 0:
                    out[-d:] += part[:d]
                elif d > 0:
                    out[:-d] += part[d:]
                else:
                    out += part
        lengths = [len(own) + REACH for own in tokens]
        out[REACH:] += np.repeat(self.files[files].astype(np.float32), lengths, axis=0) if lengths else 0
        pad = at == 0
        out[pad, 0], out[pad, 1:] = 0, -1e9
        return out, np.array(starts, dtype=np.int64)

    def slack(self) -> float:
        """The most that the chain can prefer any label to outside at one token."""
        t = self.chain
        return max(float((t[:, y][:, None] + t[y, :][None, :] - t[:, 0][:, None] - t[0, :][None, :]).max()) for y in range(1, self.labels))

    def open_tokens(self, scores: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """Tokens that the best labelling may put inside; every other token is outside in it whatever its neighbours are."""
        return np.flatnonzero(scores[:, 0] - scores[:, 1:].max(axis=1) <= self.slack() + more)

    def viterbi(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, labels) of the open tokens in the best labelling. Runs of open tokens stand between outside tokens, so
        each is decoded alone; all runs advance together."""
        places = self.open_tokens(scores)
        if not len(places):
            return places, places
        breaks = np.flatnonzero(np.diff(places) != 1) + 1
        first = np.concatenate([[0], breaks])
        size = np.diff(np.concatenate([first, [len(places)]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        own, t = scores[places].astype(np.float64), self.chain
        best = t[0][None, :] + own[first]
        back, last = [], np.zeros(len(first), dtype=np.int64)
        for step in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -step, side="left"))  # runs longer than step
            last[n:][size[n:] == step] = (best[n:] + t[:, 0]).argmax(axis=1)[size[n:] == step]
            options = best[:n, :, None] + t[None]
            back.append(options.argmax(axis=1).astype(np.int8))
            best = np.concatenate([options.max(axis=1) + own[first[:n] + step], best[n:]])
        n = int(np.searchsorted(-size, -int(size[0]), side="right"))
        last[:n] = (best[:n] + t[:, 0]).argmax(axis=1)
        labels = np.zeros(len(places), dtype=np.int64)
        labels[first + size - 1] = last
        for step in range(int(size[0]) - 1, 0, -1):
            n = len(back[step - 1])
            now = labels[first[:n] + step]
            labels[first[:n] + step - 1] = back[step - 1][np.arange(n), now]
        return places, labels

    def loopy(self, scores: np.ndarray, pairs: list[tuple[int, int, int]], starts: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
        """(places, beliefs) of the open tokens by loopy sum-product over the chain and the skip pairs (i, j, kind of skip).

        starts: first places of the texts (one text without them). Each text's messages are passed until they settle, at
        most so many rounds, whatever the other texts do. Neighbours that are outside for certain are conditioned on;
        messages are exact where the graph has no loops.
        """
        more = np.zeros(len(scores), dtype=np.float32)
        gains = np.array([max(float((m - m[:1]).max()), float((m - m[:, :1]).max())) for m in self.skips or ()], dtype=np.float32)
        links = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        for side in (0, 1):
            np.add.at(more, links[:, side], gains[links[:, 2]] if len(links) else 0)
        places = self.open_tokens(scores, more)
        if not len(places):
            return places, np.zeros((0, self.labels))
        where = np.full(len(scores), -1, dtype=np.int64)
        where[places] = np.arange(len(places))
        own = scores[places].astype(np.float64)
        left, right = where[places - 1], where[places + 1]
        own[left < 0] += self.chain[0]
        own[right < 0] += self.chain[:, 0]
        a, b, kinds = np.flatnonzero(right >= 0), right[right >= 0], np.zeros(int((right >= 0).sum()), dtype=np.int64)
        if len(links):
            x, y, kind, m = where[links[:, 0]], where[links[:, 1]], links[:, 2], np.stack(self.skips)
            both, first, second = (x >= 0) & (y >= 0), (x >= 0) & (y < 0), (x < 0) & (y >= 0)
            np.add.at(own, x[first], m[kind[first]][:, :, 0])
            np.add.at(own, y[second], m[kind[second]][:, 0])
            a, b, kinds = np.concatenate([a, x[both]]), np.concatenate([b, y[both]]), np.concatenate([kinds, kind[both] + 1])
        text_of = np.searchsorted(starts, places, side="right") if starts is not None else np.zeros(len(places), dtype=np.int64)
        order = np.argsort(text_of[a], kind="stable")
        a, b, kinds = a[order], b[order], kinds[order]
        forward = np.exp(np.stack([self.chain, *(self.skips or ())]))
        backward = forward.transpose(0, 2, 1)
        n = len(a)
        message = np.zeros((2, n, self.labels))  # along each edge, from a to b and from b to a
        live = np.arange(n)
        for _ in range(rounds):
            if not len(live):
                break
            x, y, factor, now = a[live], b[live], kinds[live], message[:, live]
            belief = own + gathered(y, now[0], len(own)) + gathered(x, now[1], len(own))
            new = np.stack([passed(belief[x] - now[1], factor, forward), passed(belief[y] - now[0], factor, backward)])
            new -= new.max(axis=2, keepdims=True)
            texts = text_of[x]
            first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
            change = np.maximum.reduceat(np.abs(new - now).max(axis=(0, 2)), first)
            moving = np.repeat(change > 1e-3, np.diff([*first, len(live)]))
            message[:, live] = np.where(moving[None, :, None], 0.5 * now + 0.5 * new, new)
            live = live[moving]
        belief = own + gathered(b, message[0], len(own)) + gathered(a, message[1], len(own))
        return places, np.exp(belief - logsumexp(belief, axis=1)[:, None])


def gathered(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows by place."""
    return np.stack([np.bincount(at, rows[:, y], n) for y in range(rows.shape[1])], axis=1)


def passed(beliefs: np.ndarray, kinds: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Messages of these log beliefs along edges of these kinds; factors: potentials of each kind."""
    weights, out = np.exp(np.maximum(beliefs - beliefs.max(axis=1, keepdims=True), -200)), np.empty_like(beliefs)
    for kind in range(len(factors)):
        own = kinds == kind
        if own.any():
            out[own] = np.einsum("nl,lm->nm", weights[own], factors[kind])  # too small for more threads
    return np.log(np.maximum(out, 1e-300))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def label_tokens(spans: list[tuple[int, int]], kinds: list[int], inside: list[int], bounds: list[tuple[int, int]]) -> list[int]:
    """Labels of tokens by span: kinds[i] at a span's first token, inside[i] at its others."""
    out, k = [0] * len(bounds), 0
    marked = sorted(zip(spans, kinds, inside, strict=True))
    begun = [False] * len(marked)
    for i, (a, b) in enumerate(bounds):
        while k < len(marked) and marked[k][0][1] <= a:
            k += 1
        for x in range(k, len(marked)):
            (lo, hi), first, rest = marked[x]
            if lo >= b:
                break
            if a < hi and lo < b:
                out[i] = rest if begun[x] else first
                begun[x] = True
                break
    return out


def fit_skips(model: Field, pairs: list[tuple[int, int, int, np.ndarray, np.ndarray]], kinds: int, rounds: int = 400, l2: float = 0.02, rate: float = 0.15) -> tuple[np.ndarray, ...]:
    """Scores of label pairs for each kind of link, by penalised maximum likelihood of the linked tokens' labels given what
    the trained chain believes of each alone. pairs: (kind, label, label, belief, belief)."""
    size = model.labels
    out = np.zeros((kinds, size, size))
    if not pairs:
        return tuple(out)
    kind, x, y = (np.array([p[k] for p in pairs]) for k in range(3))
    base = np.log(np.clip(np.array([p[3] for p in pairs]), 1e-30, 1))[:, :, None] + np.log(np.clip(np.array([p[4] for p in pairs]), 1e-30, 1))[:, None, :]
    gold = np.zeros((len(pairs), size, size))
    gold[np.arange(len(pairs)), x, y] = 1
    first, second = np.zeros_like(out), np.zeros_like(out)
    for done in range(1, rounds + 1):
        z = base + out[kind]
        z = np.exp(z - z.max(axis=(1, 2), keepdims=True))
        grad = np.zeros_like(out)
        np.add.at(grad, kind, gold - z / z.sum(axis=(1, 2), keepdims=True))
        grad = (grad + grad.transpose(0, 2, 1)) / 2 - l2 * out
        first += 0.1 * (grad - first)
        second += 0.01 * (grad**2 - second)
        out += rate * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.99**done)) + 1e-8)
    return tuple(out)


def train(windows: list[tuple[list[str], list[int], int, list[str], int | None]], labels: int, rounds: int = 100, l2: float = 1.0, rate: float = 0.15) -> Field:
    """Penalised maximum likelihood over windows (tokens, labels, file class, contexts, text that it comes from or None), by
    full-batch steps with running moments. The lexicon has words that stand near labelled tokens of several texts: else the
    words around one find that was rewritten often would speak for all of them."""
    near: dict[str, set] = {}
    for k, (tokens, marks, *_, source) in enumerate(windows):
        for i, t in enumerate(tokens):
            if any(marks[max(0, i - REACH) : i + REACH + 1]):
                near.setdefault(t.lower(), set()).add(k if source is None else source)
    lexicon = {w: i for i, (w, n) in enumerate(sorted(near.items(), key=lambda x: (-len(x[1]), x[0]))[:LEXICON_WORDS]) if len(n) >= LEAST_TEXTS}
    keys: dict = {"pad": 0}
    sequences = [[keys.setdefault((shape(t), low if (low := t.lower()) in lexicon else None, c), len(keys)) for t, c in zip(tokens, contexts, strict=True)] for tokens, _, _, contexts, _ in windows]
    weights: dict[str, int] = {}
    members = [[weights.setdefault(f, len(weights)) for f in (["pad"] if key == "pad" else features_of(*key))] for key in keys]
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    part = np.array([f for m in members for f in m])
    shift = len(OFFSETS)
    values, files, chain = np.zeros((shift, len(weights), labels)), np.zeros((FILE_CLASSES, labels)), np.zeros((labels, labels))
    model = Field(labels, lexicon, weights, values, files, chain)
    if not windows:
        values[:, :, 0] = 1
        return model
    n, size = len(windows), max(map(len, sequences))
    at = np.zeros((n, size + 2 * REACH), dtype=np.int64)
    gold = np.zeros((n, size), dtype=np.int64)
    mask = np.zeros((n, size), dtype=bool)
    for i, (s, (_, marks, *_)) in enumerate(zip(sequences, windows, strict=True)):
        at[i, REACH : REACH + len(s)], gold[i, : len(s)], mask[i, : len(s)] = s, marks, True
    classes = np.array([w[2] for w in windows])
    one_hot = np.eye(labels)[gold] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    empirical = np.zeros((labels, labels))
    np.add.at(empirical, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    ends = mask.sum(axis=1) - 1
    np.add.at(empirical, (np.zeros(n, dtype=int), gold[:, 0]), 1)
    np.add.at(empirical, (gold[np.arange(n), ends], np.zeros(n, dtype=int)), 1)
    first, second = ([np.zeros(x.shape) for x in (values, files, chain)] for _ in range(2))
    for done in range(1, rounds + 1):
        table = np.zeros((shift, len(members), labels))
        np.add.at(table, (slice(None), owner), values[:, part])
        scores = files[classes][:, None, :] + sum(table[k][at[:, REACH + d : REACH + d + size]] for k, d in enumerate(OFFSETS))
        forward = np.empty_like(scores)
        forward[:, 0] = scores[:, 0] + chain[0]
        for t in range(1, size):
            step = logsumexp(forward[:, t - 1, :, None] + chain[None], axis=1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        backward = np.empty_like(scores)
        backward[:, size - 1] = chain[:, 0]
        expected = np.zeros((labels, labels))
        total = logsumexp(forward[:, -1] + chain[:, 0], axis=1)
        for t in range(size - 2, -1, -1):
            ahead = scores[:, t + 1] + backward[:, t + 1]
            step = logsumexp(chain[None] + ahead[:, None, :], axis=2)
            use = mask[:, t + 1, None]
            backward[:, t] = np.where(use, step, backward[:, t + 1])
            pair = np.exp(forward[:, t, :, None] + chain[None] + ahead[:, None, :] - total[:, None, None])
            expected += (pair * use[:, :, None]).sum(axis=0)
        marginal = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        expected[0] += marginal[:, 0].sum(axis=0)
        expected[:, 0] += marginal[np.arange(n), ends].sum(axis=0)
        diff = one_hot - marginal
        grad_files = np.zeros_like(files)
        np.add.at(grad_files, classes, diff.sum(axis=1))
        grad_values = np.zeros_like(values)
        flat = diff.reshape(-1, labels)
        for k, d in enumerate(OFFSETS):
            rows = at[:, REACH + d : REACH + d + size].ravel()
            per_row = np.stack([np.bincount(rows, flat[:, y], len(members)) for y in range(labels)], axis=1)
            np.add.at(grad_values[k], part, per_row[owner])
        for x, grad, m, v in zip((values, files, chain), (grad_values, grad_files, empirical - expected), first, second, strict=True):
            grad = grad - l2 * x
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            x += rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + 1e-8)
    return model


def free_of(spans: list[tuple], others: list[tuple]) -> list[tuple]:
    """Of spans (kind, start, end, ...) those that overlap none of the others, by one look-up each among the others' joined
    intervals."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b, *_ in sorted(others, key=lambda s: s[1:3]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [s for s in spans if not ((k := bisect.bisect_left(starts, s[2])) and ends[k - 1] > s[1])]


def placed(text: str, lo: int, hi: int, new: str, rng: random.Random, reach: int = 300) -> tuple[str, int, int]:
    """Some of a text with `new` in place of text[lo:hi] or, as often, after any other blank; where it stands there; and the
    whole changed text's file class."""
    tail = ""
    if rng.random() < 0.5 and (at := text.find(" ", rng.randrange(len(text)))) >= 0 and not lo <= at < hi:
        lo = hi = at + 1
        tail = " "
    changed = text[max(0, lo - reach) : lo] + new + tail + text[hi : hi + reach]
    return changed, min(lo, reach), file_class(text[:lo] + new + tail + text[hi:])


def digest(*parts) -> int:
    """64-bit hash of values by their printed form."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def window_bounds(marks: list[int], hard: list[int], seed: int, reach: int = 14, most: int = 6) -> list[tuple[int, int]]:
    """Token ranges to train on: around labelled tokens, around tokens that look alike, and one picked by the seed."""
    n = len(marks)
    centres = [i for i, y in enumerate(marks) if y][:200] + hard[:4] + ([seed % n] if n else [])
    out: list[tuple[int, int]] = []
    for c in centres:
        if not any(a <= c < b - REACH for a, b in out) and len(out) < most:
            out.append((max(0, c - reach), min(n, c + reach + 1)))
    return out
