"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

Tokens carry entity labels. Besides the chain, distant tokens of a document that repeat or resemble each other share a
potential, and loopy message passing makes their labels agree: part of a number that stands whole elsewhere in the document
is personal data there too. Tokens inside the patterns' finds are known to the field, so they speak for their likes.

The field is trained on a bounded sample of texts: on the patterns' finds, on the same finds rewritten so that every pattern
misses them, on look-alikes that are no personal data (cards that fail Luhn's test, addresses beyond 255, dates, times, ISBNs,
measures and codes), and on texts that name a find again in part. Numbers tell the field whether they would pass as a card, an
address or a telephone number by their sizes and the marks between them, or stand as a date, a time or thousands; words, whether
they stand as an address. Look-alikes kept back from training set how sure the field must be of a span. The
links' potentials are fitted on linked tokens, given what the chain believes of each. Added spans never overlap the
patterns' ones.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, crf
from .secrets import in_order

#: As in secrets: shares of the windows without a find, with each kind of find (rewritten or not), and with a look-alike.
TRAIN_DOCUMENTS = 8000
TRAIN_WINDOWS = 3000
SHARES = {0: 4, 1: 2, 2: 2, 3: 2, 4: 2, 5: 9}
#: Look-alikes that the field isn't trained on and that set how sure it must be: at most this share of them may be marked.
HELD_BACK, FALSE_SHARE, LEAST_BELIEF = 4000, 0.0005, 0.8
#: Rewritings and look-alikes made of each find of the sample; pairs of linked tokens that the potentials are fitted on.
REWRITTEN, ALIKE = 4, 10
TRAIN_PAIRS = 3000

#: Characters whose tokens are held together.
SPAN_CHARS = 1 << 19

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds of links between tokens: the same, alike, the same word of a find, the last digits of a number of a find.
SKIPS = 4
KINDS = (*BASE_KINDS, *(f"crf_{k}" for k in BASE_KINDS))

#: The patterns of the base. An address is found from its @, a number from the start of its digits: both
#: give the leftmost matches without trying every start inside a long run.
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
#: Doubling of every second digit, with nines cast out.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(DOUBLED[d] for d in back[1::2])) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, kind by kind."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if text.count(".") > 2:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.groups()))]
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def found_words(tokens: list[str], marks: list[int]) -> set[str]:
    """Plain words of two letters or more inside the patterns' finds, in lower case."""
    return {t.lower() for t, y in zip(tokens, marks, strict=True) if y and len(t) > 1 and t.isalpha()}


def skip_pairs(tokens: list[str], marks: list[int] = ()) -> list[tuple[int, int, int]]:
    """(i, j, kind) of linked tokens; marks are the labels of the patterns' finds, or nothing without any.

    All repeats of a token are linked to one of them, its first inside a find or else its first, so two links join any two
    and a token has at most four of its own.
    """
    words = found_words(tokens, marks) if marks else set()
    same: dict[str, int] = {}
    alike: dict[tuple, int] = {}
    tails: dict[str, int] = {}
    for i, y in enumerate(marks):
        if y:
            t = tokens[i]
            same.setdefault(t.lower() if t.isalpha() else t, i)
            if len(t) >= 6:
                alike.setdefault((len(t), t[:3], t.isdigit()), i)
                if t.isdigit():
                    tails.setdefault(t[-4:], i)
    out = []
    for i, t in enumerate(tokens):
        if t.isalpha():
            if words and (low := t.lower()) in words and (hub := same[low]) != i:
                out.append((hub, i, 2))
        elif len(t) >= 4:
            hub = same.setdefault(t, i)
            if hub != i:
                out.append((hub, i, 0))
            if len(t) >= 6:
                hub = alike.setdefault((len(t), t[:3], t.isdigit()), i)
                if tokens[hub] != t:
                    out.append((hub, i, 1))
            elif t in tails and len(t) == 4:
                out.append((tails[t], i, 3))
    return out


#: Numbers that stand together: digit runs that are tokens, with a few blanks and marks between.
NUMBERS = re.compile(r"\b[0-9]+\b(?:[\x20.,/:()\[\]-]{1,4}\b[0-9]+\b)*")
DIGITS = re.compile(r"[0-9]+")

#: Sizes of the parts of telephone numbers without a plus sign: with an area code of three digits, maybe after
#: a prefix; or with a leading 0.
AREA = ((3, 3, 4), (1, 3, 3, 4), (3, 3, 3, 4))
TRUNK = ((5, 6), (4, 7), (4, 6), (3, 8), (3, 7), (3, 4, 4), (4, 3, 4), (5, 3, 3), (2, 4, 4))


def phone_like(groups: list[str], marks: list[str]) -> bool:
    """Whether numbers are laid out as a telephone number: an area code with brackets, dashes, dots or slashes, or after a 1
    or 001; or a leading 0 before the usual sizes. Numbers parted by blanks alone are not enough."""
    sizes = tuple(map(len, groups))
    if sizes in AREA:
        return groups[0] in ("1", "001") or (len(sizes) == 3 and any(m.strip() for m in marks))
    return sizes in TRUNK and groups[0][0] == "0" and groups[0][1] != "0"


def number_kinds(groups: list[str], marks: list[str] | None = None) -> list[str]:
    """What each number of a run of them would pass as: card (12 to 19 digits, alone or in fours, passing Luhn's test), ip
    (four in a row up to 255, a dot between any two), phone (laid out as one), local (three and four digits, a mark
    between); a no before the first two for a number of that shape that fails; date, time and money for runs of those forms;
    number otherwise. marks: what stands between the numbers."""
    n = len(groups)
    marks = [" "] * (n - 1) if marks is None else marks
    sizes = [len(g) for g in groups]
    out = ["number"] * n
    for i in range(n):
        j = i + 1
        while sizes[i] == 4 and j < n and j < i + 5 and sizes[j - 1] == 4:
            j += 1
        for end in ([i + 1] if j == i + 1 else [j, j - 1]):
            if 12 <= sum(sizes[i:end]) <= 19 and not out[i].endswith("card"):
                out[i:end] = ["card" if luhn("".join(groups[i:end])) else "nocard"] * (end - i)
                break
    i = 0
    while i < n:
        j = i
        while j < n and not out[j].endswith("card"):
            j += 1
        own, between = groups[i:j], [m.strip() for m in marks[i : max(i, j - 1)]]
        lengths = sizes[i:j]
        if len(own) == 4 and max(lengths) <= 3 and all("." in m for m in between):
            out[i:j] = ["ip" if all(map(small, own)) else "noip"] * 4
        elif len(own) > 1 and phone_like(own, marks[i : j - 1]):
            out[i:j] = ["phone"] * len(own)
        elif len(own) >= 3 and between[0] in ("-", ".", "/") and between[0] == between[1] and sorted(lengths[:3])[:2] in ([1, 1], [1, 2], [2, 2]) and max(lengths[0], lengths[2]) == 4:
            out[i:j] = ["date"] * len(own)
        elif len(own) > 1 and all(m == ":" for m in between) and max(lengths) <= 2:
            out[i:j] = ["time"] * len(own)
        elif len(own) > 1 and lengths[0] <= 3 and all(k == 3 for k in lengths[1:]) and len({*between}) == 1 and between[0] in ("", ",", "."):
            out[i:j] = ["money"] * len(own)
        else:
            for k in range(i, j - 1):
                if sizes[k : k + 2] == [3, 4] and marks[k].strip() in ("-", "."):
                    out[k : k + 2] = ["local", "local"]
        i = j + 1
    return out


#: What stands for an address's @, and the names before and after it.
AT = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s")
DOT = r"(?:\.|\sdot\s|\s?[\[(]\s?dot\s?[\])]\s?)"
BEFORE = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]{{1,64}}(?:{DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}\s?\Z")
AFTER = re.compile(rf"\s?[A-Za-z0-9-]{{1,64}}(?:{DOT}[A-Za-z0-9-]{{1,64}}){{0,5}}")


def written_addresses(text: str) -> list[tuple[int, int]]:
    """Bounds of what is laid out as an address: names on both sides of an @ or (at), or of a plain at if a dot is written out
    after it; names after a blank or a bracket have a dot."""
    out = []
    if "@" not in text and "dot" not in text and "(at" not in text and "[at" not in text:
        return out
    for m in AT.finditer(text):
        after = AFTER.match(text, m.end())
        dotted = after and ("dot" in after[0] or "." in after[0])
        if (dotted or after and m[0] == "@" and not after[0][0].isspace()) and (len(m[0].strip()) != 2 or "dot" in after[0]) and (before := BEFORE.search(text, max(0, m.start() - 200), m.start())):
            out.append((before.start(), after.end()))
    return out


def token_contexts(text: str, bounds: list[tuple[int, int]]) -> dict[int, str]:
    """What tokens would pass as: numbers by their kind, and mail inside what is laid out as an address."""
    out: dict[int, str] = {}
    place = None
    for m in NUMBERS.finditer(text):
        if place is None:
            place = {a: i for i, (a, _) in enumerate(bounds)}
        found = [(place.get(m.start() + d.start()), d[0]) for d in DIGITS.finditer(m[0])]
        marks = DIGITS.split(m[0])[1:-1]
        if m.start() and text[m.start() - 1] == "(":
            marks[:1] = ["(" + x for x in marks[:1]]
        out.update((i, kind) for (i, _), kind in zip(found, number_kinds([g for _, g in found], marks), strict=True) if i is not None)
    for lo, hi in written_addresses(text):
        out.update(dict.fromkeys(range(bisect.bisect_left(bounds, (lo, lo)), bisect.bisect_left(bounds, (hi, hi))), "mail"))
    return out


def labelled(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[tuple[int, int]], list[str], list[int]]:
    """Bounds of the tokens, the tokens, and the labels that spans of the base's kinds give them: 0, or 1 + the kind's place."""
    found = [m.span() for m in crf.TOKEN.finditer(text)]
    base = sorted(spans, key=lambda s: (s[1], BASE_KINDS.index(s[0])))
    kinds = [1 + BASE_KINDS.index(k) for k, _, _ in base]
    return found, [text[a:b] for a, b in found], crf.label_tokens([(a, b) for _, a, b in base], kinds, kinds, found)


def digits_of(n: int, rng: random.Random) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def card_number(rng: random.Random, good: bool = True) -> str:
    first = rng.choice("3456") + digits_of(14, rng)
    check = next(d for d in "0123456789" if luhn(first + d))
    return first + (check if good else str((int(check) + rng.randint(1, 9)) % 10))


def fours(number: str, sign: str) -> str:
    return sign.join(number[i : i + 4] for i in range(0, len(number), 4))


def rewritten(found: str, kind: str, rng: random.Random) -> str:
    """Personal data like the found one that stands otherwise."""
    digits = NOT_DIGITS.sub("", found)
    if kind == "email":
        local, _, domain = found.partition("@")
        at, dot = rng.choice(((" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "."), (" at ", " dot "), (" @ ", "."), ("@", None)))
        local = local.replace(".", dot) if dot and len(dot) > 2 and rng.random() < 0.5 else local
        return f"{local}{at}{domain.split('.')[0] if dot is None else domain.replace('.', dot)}"
    if kind == "ip":
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        return rng.choice((" . ", "[.]", "(.)", " .", ". ")).join(parts)
    if kind == "card":
        number = digits if rng.random() < 0.3 and len(digits) == 16 else card_number(rng)
        return fours(number, rng.choice((".", "/", "  ", ":", " - ", ",")))
    a, b, c = digits_of(3, rng), rng.choice(("555", digits_of(3, rng))), digits_of(4, rng)
    if rng.random() < 0.25:
        own = rng.choice(TRUNK)
        parts = [digits_of(n, rng) for n in own]
        return rng.choice((" ", "-", "/")).join(["0" + rng.choice("123456789") + parts[0][2:], *parts[1:]])
    return rng.choice((f"({a}) {b}-{c}", f"1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"+1/{a}/{b}/{c}", f"({a}) {b} {c}", f"{a} {b}-{c}"))


def plain_number(rng: random.Random) -> str:
    """A number, date, time, code or measure as any text may hold."""
    d = lambda n: digits_of(n, rng)
    n = rng.randint
    day, month, year, hour, minute = f"{n(1, 28):02}", f"{n(1, 12):02}", f"{n(1900, 2099)}", f"{n(0, 23):02}", f"{n(0, 59):02}"
    isbn = rng.choice((f"978{{0}}{d(1)}{{0}}{d(2)}{{0}}{d(6)}{{0}}{d(1)}", f"979{{0}}{d(2)}{{0}}{d(4)}{{0}}{d(3)}{{0}}{d(1)}", f"{d(1)}{{0}}{d(3)}{{0}}{d(5)}{{0}}X")).format(rng.choice("- "))
    small_numbers = [str(n(1, 99)) for _ in range(n(3, 6))]
    return rng.choice((
        f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{day}-{month}-{year[2:]}", f"{year}/{month}/{day}", f"{year}-{month}-{day}T{hour}:{minute}:{day}Z", f"{year}-{month}-{day} {hour}:{minute}:{day}",
        f"{day}.{month}.{year} {hour}:{minute}", f"{hour}:{minute}:{day}", f"{hour}:{minute}", f"{hour}:{minute}-{n(0, 23):02}:{day}", f"{year}{month}{day}", f"{year}{month}{day}T{hour}{minute}{day}",
        isbn, f"ISBN {isbn}", f"ISSN {d(4)}-{d(4)}", f"{n(1, 999)} {d(3)} {d(3)}", f"{n(1, 9)} {d(3)} {d(3)} {d(3)}", f"{n(1, 999)},{d(3)},{d(3)}", f"{n(1, 999)}.{d(3)}.{d(3)},{d(2)}", f"{n(1, 99)},{d(3)}.{d(2)}",
        f"{n(0, 9)}.{d(5)} {d(5)}", f"{n(0, 999)}.{d(n(1, 9))}", f"-{n(0, 99)}.{d(4)}, {n(0, 180)}.{d(4)}", f"{n(0, 89)}°{minute}'{day}\"", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 99)}-{n(1, 9)}",
        "-".join(small_numbers), " ".join(small_numbers), ", ".join(small_numbers), f"{year}-{int(year) + n(1, 9)}", f"pp. {n(1, 400)}-{n(401, 999)}", f"({year}) {d(3)}-{d(3)}", f"{d(3)} ({year}) {d(4)}", f"{n(1, 20)}:{n(1, 50)}-{n(51, 99)}",
        f"{rng.choice('ABCDEKMX')}{d(n(2, 6))}", f"{rng.choice(('AB', 'PX', 'Mod', 'SKU'))}-{d(4)}-{d(3)}", f"part no. {d(3)} {d(3)} {d(4)}", f"No. {d(n(3, 8))}", f"#{d(n(2, 7))}", f"{d(3)} {d(3)} {d(4)}", f"{d(n(5, 11))}", f"order {d(3)}-{d(7)}-{d(7)}",
        f"{n(1, 500)}kg", f"{n(1, 90)}th", f"{n(2, 9)}x{n(2, 9)}", f"{n(100, 4000)}x{n(100, 4000)}", f"{d(2)}%", f"${n(1, 999)}.{d(2)}", f"1/{n(2, 9)}", f"{n(1, 9)}e-{n(1, 9)}", f"0x{d(4)}", f"{d(2)}:{d(2)}:{d(2)}:{d(2)}", f"{d(4)} {d(4)}", f"{d(5)}-{d(4)}", f"{n(1, 9)}:{n(1, 9)}",
    ))


def look_alike(kind: str, rng: random.Random) -> str:
    """What stands where personal data stood and is none: near misses of the kind, and plain numbers and codes."""
    d = lambda n: digits_of(n, rng)
    if rng.random() < 0.6:
        return plain_number(rng)
    if kind == "card":
        return fours(card_number(rng, False), rng.choice(("", "", "", " ", "-", ".", "/", ":")))
    if kind == "ip":
        parts = [d(rng.randint(1, 3)) for _ in range(4)]
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return rng.choice((".".join(parts), " . ".join(parts), "-".join(parts), f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(2)}"))
    if kind == "phone":
        return rng.choice((f"{d(3)}-{d(4)}", f"({d(3)})", f"+{d(2)}", f"{d(4)}", f"ending {d(4)}", f"{d(13)}"))
    return rng.choice(("we met at home", "it was at ten dot on", "@name", "mail at once", "up (at) last", "see example.org", "mail7.example.com", "at mail", "a @ b", "name.", "dot com", "at 10.30", "at. at. at. at.", "at at at at", "dot dot dot", "at. dot. at. dot.", "[at]", "(dot)"))


def echo(found: str, kind: str, rng: random.Random) -> str | None:
    """Part of a find, as a text names it again."""
    digits = NOT_DIGITS.sub("", found)
    if kind == "card":
        return rng.choice(("ending ", "card ", "")) + digits[-4:]
    if kind == "phone" and len(digits) >= 10:
        return digits[-7:-4] + rng.choice("- .") + digits[-4:]
    return None


COLUMNS = ("hash", "kind", "tokens", "marks", "file", "contexts", "source")


def window_rows(text: str, spans: list[tuple[str, int, int]], kind: int | None, at: int | None = None, file: int | None = None, alike: int = 0) -> list[tuple]:
    """COLUMNS but the last of windows of one text, as in secrets. kind: None for the rarest label of a window. alike: length of
    the look-alike at `at`, whose tokens are marked -1."""
    bounds, tokens, marks = labelled(text, spans)
    if alike:
        marks = [-1 if not y and at <= a < at + alike else y for y, (a, _) in zip(marks, bounds, strict=True)]
    contexts, file = token_contexts(text, bounds), crf.file_class(text) if file is None else file
    held = Counter(marks)
    if at is None:
        hard = [i for i, t in enumerate(tokens) if not marks[i] and len(t) >= 4 and not t.isalpha()]
        ranges = crf.window_bounds(marks, hard, zlib.crc32(text.encode()))
    else:
        centre = bisect.bisect_left(bounds, (at, at))
        ranges = [(max(0, centre - 12), min(len(tokens), centre + 20))]
    out = []
    for a, b in ranges:
        window = ([t[:64] for t in tokens[a:b]], marks[a:b], file, [contexts.get(i, "") for i in range(a, b)])
        own = min({*marks[a:b]} - {0}, key=lambda y: (held[y], y), default=0) if kind is None else kind
        out.append((crf.digest(*window), own, *window))
    return out


def pair_rows(text: str, base: list[tuple[str, int, int]], spans: list[tuple[str, int, int]], reach: int = 8) -> list[dict]:
    """Linked tokens of a text, at most one that are both outside for each kind of link, each with its window: tokens of
    both windows one after the other, where the second begins, both places, both labels, and whether a pattern knows them."""
    bounds, tokens, known = labelled(text, base)
    marks = labelled(text, spans)[2] if spans is not base else known
    contexts, file = token_contexts(text, bounds), crf.file_class(text)
    out, plain = [], set()
    for i, j, kind in skip_pairs(tokens, known if base else ()):
        if known[i] and known[j] or not marks[i] and not marks[j] and kind in plain:
            continue
        if not marks[i] and not marks[j]:
            plain.add(kind)
        a, b, c, d = max(0, i - reach), i + reach + 1, max(0, j - reach), j + reach + 1
        both = [*range(a, min(b, len(tokens))), *range(c, min(d, len(tokens)))]
        row = {"tokens": [tokens[k][:64] for k in both], "contexts": [contexts.get(k, "") for k in both], "file": file, "cut": min(b, len(tokens)) - a, "i": i - a, "j": j - c, "skip": kind, "labels": [marks[i], marks[j]], "known": [bool(known[i]), bool(known[j])]}
        out.append({"hash": crf.digest(*row.values()), **row})
        if len(out) >= 8:
            break
    return out


def training_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Windows (pair null) and pairs of linked tokens (window null) of these texts."""

    def make():
        def handle(ids, values):
            windows: list[tuple] = []
            pairs: list[dict] = []
            for text in values:
                base = base_spans(text)
                source = zlib.crc32(text.encode())
                windows += [(*r, source) for r in window_rows(text, base, None)]
                pairs += pair_rows(text, base, base)
                rng = random.Random(source)
                for kind, lo, hi in base:
                    label, found = 1 + BASE_KINDS.index(kind), text[lo:hi]
                    for n in range(REWRITTEN + ALIKE):
                        new = rewritten(found, kind, rng) if n < REWRITTEN else look_alike(kind, rng)
                        changed, at, file = crf.placed(text, lo, hi, new, rng)
                        known = base_spans(changed)
                        if any(a < at + len(new) and at < b for _, a, b in known):
                            continue  # a pattern finds it, or some of it
                        windows += [(*r, source) for r in window_rows(changed, known + [(kind, at, at + len(new))] * (n < REWRITTEN), label if n < REWRITTEN else 5, at, file, 0 if n < REWRITTEN else len(new))]
                    if (again := echo(found, kind, rng)) is not None:
                        words = text[:200].split()[:12]
                        changed = text + "\n" + " ".join(words[:6]) + " "
                        at = len(changed)
                        changed += again + " " + " ".join(words[6:])
                        skipped = len(again) - len(again.lstrip("abcdefghijklmnopqrstuvwxyz "))
                        known = base_spans(changed)
                        if not any(a < at + len(again) and at < b for _, a, b in known):
                            pairs += [p for p in pair_rows(changed, known, known + [(kind, at + skipped, at + len(again))]) if not all(p["known"])][-2:]
            out = {c: [r[k] for r in windows] + [None] * len(pairs) for k, c in enumerate(COLUMNS)}
            out["hash"] = [r[0] for r in windows] + [p["hash"] for p in pairs]
            out["kind"] = [r[1] for r in windows] + [-1] * len(pairs)
            out["pair"] = [None] * len(windows) + pairs
            return out

        return handle

    pair = "struct<tokens: array<string>, contexts: array<string>, file: int, cut: int, i: int, j: int, skip: int, labels: array<int>, known: array<boolean>>"
    return common.saved(common.map_texts(docs, make, f"hash long, kind int, tokens array<string>, marks array<int>, file int, contexts array<string>, source long, pair {pair}", id_col, text_col), "pii-windows")


def beliefs_of(model: crf.Field, tokens: list[list[str]], contexts: list[dict[int, str]], files: list[int], at: list[int]) -> np.ndarray:
    """What the chain alone believes of one token of each of these windows."""
    scores, starts = model.scores(["" for _ in tokens], tokens, contexts)
    for start, own, file in zip(starts, tokens, files, strict=True):
        scores[start : start + len(own)] += (model.files[file] - model.files[crf.file_class("")]).astype(np.float32)
    places, beliefs = model.loopy(scores, [], starts)
    # a token that is outside for certain has neighbours that are, too
    out = scores[starts + np.array(at, dtype=np.int64)] + model.chain[0] + model.chain[:, 0]
    out = np.exp(out - crf.logsumexp(out, axis=1)[:, None])
    where = dict(zip(places.tolist(), range(len(places)), strict=True))
    for k, (start, i) in enumerate(zip(starts.tolist(), at, strict=True)):
        if (p := where.get(start + i)) is not None:
            out[k] = beliefs[p]
    return out


def linked_pairs(model: crf.Field, rows: list) -> list[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """The rows' pairs as crf.fit_skips takes them; what a pattern knows is certain."""
    sides = []
    for first in (True, False):
        own = [slice(0, r["cut"]) if first else slice(r["cut"], None) for r in rows]
        contexts = [{i: c for i, c in enumerate(r["contexts"][s]) if c} for r, s in zip(rows, own, strict=True)]
        beliefs = beliefs_of(model, [r["tokens"][s] for r, s in zip(rows, own, strict=True)], contexts, [r["file"] for r in rows], [r["i"] if first else r["j"] for r in rows])
        for k, r in enumerate(rows):
            if r["known"][not first]:
                beliefs[k] = np.eye(model.labels)[r["labels"][not first]]
        sides.append(beliefs)
    return [(r["skip"], *r["labels"], a, b) for r, a, b in zip(rows, *sides, strict=True)]


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> crf.Field:
    rows = training_rows(common.sample_of(docs, TRAIN_DOCUMENTS, text_col), id_col, text_col)
    back = (F.col("kind") == 5) & (F.pmod("hash", F.lit(4)) == 0)
    held = rows.filter("pair IS NULL").drop("pair")
    windows = common.fair_share(held.filter(~back), TRAIN_WINDOWS, SHARES).collect()
    pairs = rows.filter("pair IS NOT NULL").select("hash", "pair.skip", "pair").dropDuplicates(["hash"])
    pairs = common.fair_share(pairs.withColumnRenamed("skip", "kind"), TRAIN_PAIRS, dict.fromkeys(range(SKIPS), 1)).collect()
    model = crf.train([(r["tokens"], [max(y, 0) for y in r["marks"]], r["file"], r["contexts"], r["source"]) for r in windows], len(BASE_KINDS) + 1)
    model.skips = crf.fit_skips(model, linked_pairs(model, [r["pair"] for r in pairs]), SKIPS)
    model.sure = least_belief(model, common.fair_share(held.filter(back), HELD_BACK, {5: 1}).collect())
    return model


def least_belief(model: crf.Field, rows: list) -> np.ndarray:
    """For each label the belief that at most FALSE_SHARE of these windows reach at a token of their look-alikes, but for numbers
    that pass as a card. LEAST_BELIEF at least, as few windows tell little."""
    scores, starts = model.scores(["" for _ in rows], [r["tokens"] for r in rows], [{i: c for i, c in enumerate(r["contexts"]) if c} for r in rows])
    counted = np.zeros(len(scores), bool)
    for start, r in zip(starts.tolist(), rows, strict=True):
        here = slice(start, start + len(r["tokens"]))
        scores[here] += (model.files[r["file"]] - model.files[crf.file_class("")]).astype(np.float32)
        for i, y in enumerate(r["marks"]):
            if y > 0:
                scores[start + i] = crf.NEVER
                scores[start + i, y] = 0
        counted[here] = [y < 0 and c != "card" for y, c in zip(r["marks"], r["contexts"], strict=True)]
    places, beliefs = model.loopy(scores, [], starts)
    top = np.zeros(scores.shape)
    top[places] = beliefs
    top[~counted] = 0
    most = np.array([top[s : s + len(r["tokens"])].max(axis=0) for s, r in zip(starts.tolist(), rows, strict=True)]).reshape(-1, model.labels)
    bound = -np.sort(-most, axis=0)[int(FALSE_SHARE * len(most))] if len(most) else np.zeros(model.labels)
    return np.maximum(LEAST_BELIEF, bound)


def tagged_spans(model: crf.Field, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) by the field, for each text and its patterns' spans."""
    tokens, contexts, known = [], [], []
    for text, base in zip(texts, bases, strict=True):
        if base or DIGIT.search(text) or written_addresses(text):
            bounds, own, marks = labelled(text, base)
            contexts.append(token_contexts(text, bounds))
        else:
            own, marks = crf.TOKEN.findall(text), []
            contexts.append({})
        tokens.append(own)
        known.append(marks if base else [])
    scores, starts = model.scores(texts, tokens, contexts)
    pairs: list[tuple[int, int, int]] = []
    for start, own, marks in zip(starts.tolist(), tokens, known, strict=True):
        pairs += [(start + i, start + j, kind) for i, j, kind in skip_pairs(own, marks)]
        for i, y in enumerate(marks):
            if y:
                scores[start + i] = crf.NEVER
                scores[start + i, y] = 0
    places, beliefs = model.loopy(scores, pairs, starts)
    labels = beliefs.argmax(axis=1)
    marked = places[labels > 0]
    label_at = dict(zip(marked.tolist(), labels[labels > 0].tolist(), strict=True))
    belief_at = dict(zip(marked.tolist(), beliefs.max(axis=1)[labels > 0].tolist(), strict=True))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for k in sorted(set((starts.searchsorted(marked, side="right") - 1).tolist())):
        before, own, spans, held = (-2, 0), False, out[k], []
        for i, m in enumerate(crf.TOKEN.finditer(texts[k])):
            y = label_at.get(int(starts[k]) + i, 0)
            if not y:
                continue
            # what goes on from a known find with its label is no find of its own: that one's bounds stand
            joined = before == (i - 1, y)
            before = (i, y)
            if known[k] and known[k][i]:
                own = False
            elif not joined:
                own = True
                spans.append((f"crf_{BASE_KINDS[y - 1]}", *m.span()))
                held.append([belief_at[int(starts[k]) + i]])
            elif own:
                spans[-1] = (spans[-1][0], spans[-1][1], m.end())
                held[-1].append(belief_at[int(starts[k]) + i])
        least = model.sure if model.sure is not None else np.zeros(model.labels)
        out[k] = [s for s, own in zip(spans, held, strict=True) if sum(own) > least[1 + KINDS.index(s[0]) - len(BASE_KINDS)] * len(own)]
    return out


def all_spans(model: crf.Field, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """The patterns' spans and the added ones of each text; an added span holds a letter or digit. Texts are tagged together
    up to SPAN_CHARS characters, so that the tokens of few are held at a time."""
    out, lo, held = [], 0, 0
    for hi, text in enumerate(texts, 1):
        held += len(text)
        if held >= SPAN_CHARS or hi == len(texts):
            part = texts[lo:hi]
            bases = [base_spans(t) for t in part]
            out += [(base, [s for s in crf.free_of(added, base) if any(map(str.isalnum, t[s[1] : s[2]]))]) for t, base, added in zip(part, bases, tagged_spans(model, part, bases), strict=True)]
            lo, held = hi, 0
    return out


def find_personal_data(docs: DataFrame, model: crf.Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row's whole text.

    spans: kind:start:end in code points, end exclusive, by start and kind; kinds crf_* for spans that only the field
    finds. model: None trains one on a bounded sample of docs. A null or empty text has no spans, and its base_sha256 is
    that of the empty string. Repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
    """
    field = model or train_field(docs, id_col, text_col)

    def make():
        def handle(ids, values):
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for doc_id, (base, added) in zip(ids, all_spans(field, values), strict=True):
                kinds = [k for k, _, _ in base]
                out["doc_id"].append(doc_id)
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(in_order(base, KINDS).encode()).hexdigest())
                out["spans"].append(in_order(base + added, KINDS))
            return out

        return handle

    return common.map_texts(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", id_col, text_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or several that overlap, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"<{kind.removeprefix('crf_').upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_personal_data(docs: DataFrame, model: crf.Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, with the personal data of the text replaced: of spans that overlap, the first by start and
    kind names what stands there. A null text stays null, an empty one empty; repeated rows are treated alike; an empty
    table stays empty."""
    common.bounded_batches(docs.sparkSession)
    field = model or train_field(docs, id_col, text_col)

    @F.pandas_udf("string")
    def clean(values):
        texts = values.tolist()
        out = []
        for lo, hi in common.slices(len(t or "") for t in texts):
            part = texts[lo:hi]
            known = [t or "" for t in part]
            out += [t if t is None else redacted(t, base + added) for t, (base, added) in zip(part, all_spans(field, known), strict=True)]
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
