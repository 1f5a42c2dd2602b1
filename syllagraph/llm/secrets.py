"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as begin, inside or outside of a secret from shape, neighbouring words and file features, and is
decoded by Viterbi. It is trained on a bounded sample of texts: on the patterns' finds, on the same finds rewritten so that
every pattern misses them (another name or sign before the value, another case, no name), and on look-alikes that are no
secrets. So it marks what looks and stands like a secret but misses a pattern. Its spans never replace or overlap the
patterns' ones.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib

from pyspark.sql import DataFrame

from . import common, crf

#: Texts of the sample that the field is fitted on, and most windows taken from them: equal ones once, and a share for each
#: of: no find, a find, a rewritten find, a look-alike (more of one where another has too few), by a hash of the window.
TRAIN_DOCUMENTS = 8000
TRAIN_WINDOWS = 2800
SHARES = {0: 3, 1: 1, 2: 5, 3: 3}
#: Rewritings and look-alikes made of each find of the sample.
REWRITTEN, ALIKE = 6, 4
OUTSIDE, BEGIN, INSIDE = 0, 1, 2

#: The patterns of the base, by kind, in the order of ties.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Names and signs that no pattern knows, for rewritten finds.
NAMES = ("pwd", "pass", "passphrase", "credential", "credentials", "private_key", "access_key", "auth", "bearer", "client_key", "signing_key", "login")
SIGNS = (" = ", ": ", "=", " is ", " is ", " -> ", " => ", " ", " was ")
BASE_SIGNS = (" is ", " -> ", " => ", " was ", " -- ")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, kind by kind. A run of hexadecimal digits is found whole, so one of under 24
    is skipped at once."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def in_order(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2])))


def rewritten(found: str, kind: str, rng: random.Random) -> str:
    """A secret like the found one that stands otherwise."""
    m = ASSIGN.fullmatch(found)
    value = m[2] if m else found
    quote = rng.choice(('"', "'", "", ""))
    how = rng.random()
    if kind == "access":
        return rng.choice(("ASIA", "AGPA", "AIDA", "AROA")) + "".join(rng.choice(LETTERS[:26] + LETTERS[-10:]) for _ in range(16))
    if how < 0.25:
        value = value.upper()
    elif how < 0.8:
        letters, n = rng.choice((LETTERS, LETTERS, LETTERS[26:], LETTERS[:26] + LETTERS[-10:])), rng.randint(8, 40)
        value = "".join(rng.choice(letters) for _ in range(n - 2)) + rng.choice("0123456789") + rng.choice(letters)
    if len(value) >= 16 and rng.random() < 0.2:
        return f'"{value}"'
    if m and rng.random() < 0.4:
        return m[1] + rng.choice(BASE_SIGNS) + quote + value + quote
    return rng.choice(NAMES) + rng.choice(SIGNS) + quote + value + quote


def look_alike(found: str, kind: str, rng: random.Random) -> str:
    """What stands where a secret stood and is none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = rng.choice((*WORDS, *NAMES))
    return rng.choice((
        f"{name} of the", f"the {name}", f"{name}: none", f"{name} = null", f"{name} is required", f"version = {digits(1)}.{digits(2)}.{digits(1)}", f"id = {digits(rng.randint(4, 18))}", f"no. {digits(16)}",
        f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"commit {hexes(7)}", f"key {digits(3)}", f"page {digits(2)}a", f"img/{hexes(4)}{digits(2)}.png", f"user{digits(2)}@mail{digits(1)}.example.org", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(1)}",
    ))


def window_rows(text: str, spans: list[tuple[int, int]], kind: int | None, at: int | None = None, file: int | None = None) -> list[tuple]:
    """(hash, kind, tokens, marks, file class) of windows of one text; around the token at this place alone, if one is
    given. kind: None for 1 where a span stands, else 0."""
    bounds = [m.span() for m in crf.TOKEN.finditer(text)]
    marks = crf.label_tokens(spans, [BEGIN] * len(spans), [INSIDE] * len(spans), bounds)
    tokens = [text[a:b] for a, b in bounds]
    file = crf.file_class(text) if file is None else file
    if at is None:
        hard = [i for i, t in enumerate(tokens) if not marks[i] and len(t) >= 8 and not t.isalpha()]
        ranges = crf.window_bounds(marks, hard, zlib.crc32(text.encode()))
    else:
        centre = bisect.bisect_left(bounds, (at, at))
        ranges = [(max(0, centre - 12), min(len(tokens), centre + 20))]
    out = []
    for a, b in ranges:
        window = ([t[:64] for t in tokens[a:b]], marks[a:b], file)
        out.append((crf.digest(*window), int(any(marks[a:b])) if kind is None else kind, *window))
    return out


def training_windows(docs: DataFrame, id_col: str, text_col: str) -> list[tuple[list[str], list[int], int, list[str], int]]:
    """Different token windows of a bounded sample of texts: a fair share of finds, rewritten ones, look-alikes and others."""
    columns = ("hash", "kind", "tokens", "marks", "file", "source")

    def make():
        def handle(ids, values):
            rows: list[tuple] = []
            for text in values:
                base = base_spans(text)
                source = zlib.crc32(text.encode())
                rows += [(*r, source) for r in window_rows(text, [s[1:] for s in base], None)]
                rng = random.Random(source)
                for kind, lo, hi in base:
                    # the patterns that overlap this find go with it
                    lo = min([lo, *(a for _, a, b in base if a < hi and lo < b)])
                    hi = max([hi, *(b for _, a, b in base if a < hi and lo < b)])
                    for n in range(REWRITTEN + ALIKE):
                        new = (rewritten if n < REWRITTEN else look_alike)(text[lo:hi], kind, rng)
                        changed, at, file = crf.placed(text, lo, hi, new, rng)
                        known = [s[1:] for s in base_spans(changed)]
                        if any(a < at + len(new) and at < b for a, b in known):
                            continue  # a pattern finds it, or some of it
                        rows += [(*r, source) for r in window_rows(changed, known + [(at, at + len(new))] * (n < REWRITTEN), 2 if n < REWRITTEN else 3, at, file)]
            return {c: [r[k] for r in rows] for k, c in enumerate(columns)}

        return handle

    some = common.sample_of(docs, TRAIN_DOCUMENTS, text_col)
    rows = common.map_texts(some, make, "hash long, kind int, tokens array<string>, marks array<int>, file int, source long", id_col, text_col)
    return [(r["tokens"], r["marks"], r["file"], [""] * len(r["tokens"]), r["source"]) for r in common.fair_share(rows, TRAIN_WINDOWS, SHARES).collect()]


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> crf.Field:
    return crf.train(training_windows(docs, id_col, text_col), 3)


def tagged_spans(model: crf.Field, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Spans of each text by the field's best labelling: from a begin (or a first inside) to the last inside token."""
    tokens = [crf.TOKEN.findall(t) for t in texts]
    scores, starts = model.scores(texts, tokens)
    places, labels = model.viterbi(scores)
    marked = places[labels > 0]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    label_at = dict(zip(marked.tolist(), labels[labels > 0].tolist(), strict=True))
    for k in sorted(set((starts.searchsorted(marked, side="right") - 1).tolist())):
        spans = out[k]
        before = -2
        for i, m in enumerate(crf.TOKEN.finditer(texts[k])):
            y = label_at.get(int(starts[k]) + i)
            if y is None:
                continue
            if y == INSIDE and before == i - 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append(m.span())
            before = i
    return out


def scan_secrets(docs: DataFrame, model: crf.Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row's whole text.

    spans: kind:start:end in code points, end exclusive, by start and kind; kind crf for spans that only the field finds.
    model: None trains one on a bounded sample of docs. A null or empty text has no spans, and its base_sha256 is that of
    the empty string. Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    field = model or train_field(docs, id_col, text_col)

    def make():
        def handle(ids, values):
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for doc_id, text, added in zip(ids, values, tagged_spans(field, values), strict=True):
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                out["doc_id"].append(doc_id)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(in_order(base, KINDS).encode()).hexdigest())
                out["spans"].append(in_order(base + crf.free_of([("crf", *s) for s in added], base), KINDS))
            return out

        return handle

    return common.map_texts(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", id_col, text_col)
