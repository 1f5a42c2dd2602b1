"""Language by context trees, the audit of filters and the alignment of tokenizers against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from syllagraph.llm import filter_audit, language_ppm, token_alignment

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, source string, lang string, run long, n_a string, alive int, part string"


def frame(spark, rows):
    """Documents of (doc_id, text, source, lang), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "x", 1, "y") for r in rows], DOCS)


# languages


def plain_bits(counts, order, least, text):
    """Code length of a text by the definition: longest context first, symbols of the contexts escaped from left out."""
    kept = {g: n for g, n in counts.items() if len(g) <= 2 or n >= least}
    follow = defaultdict(dict)
    for g, n in kept.items():
        follow[g[:-1]][g[-1]] = n
    bits = 0.0
    for i, s in enumerate(text):
        context, out = text[max(i - order, 0) : i], set()
        while True:
            if context in follow:
                own = {b: n for b, n in follow[context].items() if b not in out}
                total, kinds = sum(own.values()), len(own)
                if s in own:
                    bits += math.log2((total + kinds) / own[s])
                    break
                if own:
                    bits += math.log2((total + kinds) / kinds)
                out |= set(follow[context])
            if not context:
                bits += math.log2(256 - len(out))
                break
            context = context[1:]
    return bits


def test_code_lengths_equal_the_definition():
    rng = random.Random(4)
    train = {"x": ["abracadabra abra", "cabbage and abba éé"], "y": ["zyzzyva zebra", "lazy zyz abr"], "z": ["q"]}
    counts = {lang: Counter(t.encode()[i : i + k] for t in texts for k in range(1, language_ppm.ORDER + 2) for i in range(len(t.encode()) - k + 1)) for lang, texts in train.items()}
    rows = [(i, len(g), int.from_bytes(g), n) for i, lang in enumerate(train) for g, n in counts[lang].items() if len(g) <= 2 or n >= language_ppm.LEAST]
    trees = language_ppm.ContextTrees(list(train), *(np.array([r[i] for r in rows]) for i in range(4)))
    texts = ["a", "abra", "zyzzyva", "éabr", "#", "abracadabra zyzzyva q"] + ["".join(rng.choice("abrcdz yqé#") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in raw])
    for block in (1 << 18, 7, 1):
        language_ppm.BLOCK, before = block, language_ppm.BLOCK
        try:
            got = trees.scored(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes)
        finally:
            language_ppm.BLOCK = before
        want = [[plain_bits(counts[lang], language_ppm.ORDER, language_ppm.LEAST, t) for lang in train] for t in raw]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_ppm.identify_languages(docs).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows if r.held_out) >= 0.97 * sum(r.held_out for r in rows)


def test_language_of_odd_rows(spark):
    words = {"x": "nohe rilu mata", "y": "gruft kralz pfusch"}
    rows = [(i, f"{words[lang]} {i} " * 9, "s", lang) for i in range(40) for lang in "xy"]
    odd = [(1, None, None, "x"), (2, "", "s", "x"), (3, "12 !² \n", "s", "x"), (None, words["x"], "s", None), (4, words["y"], "s", None), (4, words["y"], "s", None), (5, "é", "s", None), (6, words["y"] * 40_000, "s", None)]
    got = language_ppm.identify_languages(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in got[len(rows) :]:
        by[r.doc_id].append(r.lang_pred)
    assert by[None] == ["x"] and by[4].count("y") >= 2 and "und" in by[1] and "und" in by[2] and "und" in by[3] and "y" in by[6]
    assert language_ppm.identify_languages(frame(spark, [])).collect() == []
    alone = language_ppm.identify_languages(frame(spark, [(9, "abc", "s", None)])).collect()
    assert [(r.lang_pred, r.score, r.bits_per_byte) for r in alone] == [("und", 0.0, None)]


# filters


def plain_audit(docs, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    rows = []
    for i, text, source, _ in docs:
        text = text or ""
        words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in text).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text]}
        rows.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, share = [r for r in rows if r[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                share[f] += len(gone)
                fail = [r for r in own if f in r[1]]
                out[part, order, step] = [len(left), len(gone), len(fail) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(share[key[1][key[2] - 1]])
    return out


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_equals_the_definition(spark):
    rng = random.Random(6)
    texts = [None, "", "A", "a b " * 60, " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(60)) + " |", " ".join(f"W{i}" for i in range(49)), "x\x1cy\x0bz " * 80, " ".join(str(i) for i in range(30_000))]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "s", "t"]), "en") for _ in range(300)]
    docs += [docs[0]] * 70
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 40, 2), 4, 4, None]]
    got = filter_audit.audit_filters(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in FIGURES] for r in got} == plain_audit(docs, labels)
    assert len(got) == 3 * 600
    assert filter_audit.audit_filters(frame(spark, []), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


def test_carry_save_counts_bits():
    rng = np.random.default_rng(2)
    levels = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (1000, 0, 7, 2, 100)]
    want = [sum(int(w >> s & 1) << k for k, words in enumerate(levels) for w in words.tolist()) for s in range(32)]
    assert filter_audit.carry_save(levels) == want


# alignment


def plain_alignment(texts):
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(token_alignment.byte_letters())}
    spelt = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    rows, count = [], Counter()
    for t in texts:
        ids = a.encode(f" {t}", add_special_tokens=False).ids if t else []
        pieces = b.encode(t) if t else []
        long_a, long_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids], [spelt(b.id_to_piece(i)) for i in pieces]
        if not t or b"".join(long_a) != f" {t}".encode() or b"".join(long_b) != f" {t}".encode():
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (long_a, long_b)]
        starts = [[0, *e[:-1]] for e in ends]
        links, j = [], 0
        for i in range(len(ids)):
            while ends[1][j] <= starts[0][i]:
                j += 1
            k = j
            while k < len(pieces) and starts[1][k] < ends[0][i]:
                links.append((ids[i], pieces[k]))
                k += 1
        groups, lo = [], (0, 0)
        for end in sorted(set(ends[0]) & set(ends[1])):
            hi = (ends[0].index(end) + 1, ends[1].index(end) + 1)
            groups.append((ids[lo[0] : hi[0]], pieces[lo[1] : hi[1]]))
            lo = hi
        count.update(links)
        rows.append((ids, pieces, groups, links))
    most = defaultdict(int)
    for (_, p), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ids, pieces, groups, links = r
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(ids), len(pieces), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["", " ", "  \n\n  hello  　w\x1c.\x1f.\x85z ", "a<|endoftext|>b", "</s><0x0A><unk>", "▁a", "x" * 3000, "don't \U0001f600é ́x ΣΑΣ", " \t\t\t ", "a\x00b", "１２３²½ 一二", "\n" * 500 + "x", "ab" * 1500]
PARTS = [" ", "  ", "the", " in", "\n", "é", "日", "\U0001f600", "a", "aa", "er", "ing", "http", "://", "0", "12", "x" * 9, ".", ",", "'s", "A", "<|endoftext|>", " tokenization", "▁"]


@pytest.mark.parametrize(("run_links", "fan_in", "block"), [(4_000_000, 64, 1 << 17), (300, 3, 50)])
def test_alignment_equals_the_definition(spark, monkeypatch, run_links, fan_in, block):
    monkeypatch.setattr(token_alignment, "FAN_IN", fan_in)
    rng = random.Random(7)
    texts = [None, *ODD, *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(400))]
    texts += [" common words"] * 300
    order = list(range(len(texts)))
    rng.shuffle(order)
    ids = [None if i % 97 == 0 else i for i in order]
    rows = [(i, texts[k], "s", "en") for i, k in zip(ids, order, strict=True)]
    bounds = {"RUN_LINKS": run_links, "BLOCK_PAIRS": block, "BATCH_CHARS": 200 if run_links < 1000 else 1 << 20}
    for name, value in bounds.items():
        monkeypatch.setattr(token_alignment, name, value)
    got = token_alignment.align_tokenizers(frame(spark, rows), BYTE, PIECE).collect()
    want = plain_alignment([r[1] for r in rows])
    assert Counter((r.doc_id, *(r[c] for c in ALIGNED)) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert token_alignment.align_tokenizers(frame(spark, []), BYTE, PIECE).collect() == []


def test_merge_opens_runs_when_they_are_reached():
    rng = np.random.default_rng(5)
    runs, want = [], Counter()
    for _ in range(9):
        pairs = np.unique(rng.integers(0, 4000, 300))
        links = rng.integers(1, 1 << 40, len(pairs))
        want.update(dict(zip(pairs.tolist(), links.tolist(), strict=True)))
        for lo in range(0, len(pairs), 70):
            runs.append((int(pairs[lo]), token_alignment.pack(pairs[lo : lo + 70], links[lo : lo + 70])))
    got, seconds = {}, []
    for pairs, links in token_alignment.merged(sorted(runs), 100):
        seconds.append(int(pairs[0]) // 100)
        assert set((pairs // 100).tolist()) == {seconds[-1]}
        got.update(zip(pairs.tolist(), links.tolist(), strict=True))
    assert got == dict(want) and seconds == sorted(set(seconds))
