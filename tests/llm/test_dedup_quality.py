"""Exact and near copies, quality rules and classifier, and the pipeline, against plain versions."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from syllagraph.llm import components, exact_dedup, near_join, packing, pii, quality_gbt, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "h") for i, t in rows], "doc_id long, text string, kept string, n_words int, key string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def plain_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, t or ""): (max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


@pytest.mark.parametrize("bounds", [{}, {"bucket_rows": 3}, {"bucket_rows": 40, "hash_of": lambda t: F.shiftleft(F.length(t).cast("long"), 40)}], ids=["usual", "small", "collisions"])
def test_exact_dedup(spark, docs, bounds):
    more = frame(spark, [(10_000, None), (10_001, ""), (10_002, "a" * 100_000), (10_003, "a" * 100_000), (10_004, "b"), (10_005, "b"), (10_006, "b"), (10_007, "b ")]).select("doc_id", "text")
    rows = docs.select("doc_id", "text").union(more)
    known = plain_copies([tuple(r) for r in rows.collect()])
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    found = exact_dedup.exact_dedup(rows, **bounds).collect()
    assert len(found) == len(known)
    for r in found:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) == known[r["doc_id"], texts[r["doc_id"]]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    left = exact_dedup.distinct_documents(rows, **bounds)
    assert left.columns == rows.columns and left.count() == len(set(texts.values()))


@pytest.mark.parametrize("bounds", [{}, {"bucket_rows": 1}])
def test_exact_dedup_of_odd_rows(spark, bounds):
    rows = frame(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, "")])
    found = exact_dedup.exact_dedup(rows, **bounds).collect()
    assert collections.Counter((r["text_sha256"][:4], r["keep_id"], r["kept"]) for r in found) == collections.Counter(
        {(hashlib.sha256(t.encode()).hexdigest()[:4], k, kept): n for t, k, kept, n in (("a", 1, True, 1), ("a", 1, False, 2), ("b", None, True, 1), ("b", None, False, 1), ("", 3, True, 1), ("", 3, False, 1))}
    )
    kept = exact_dedup.distinct_documents(rows, **bounds)
    assert kept.columns == rows.columns and sorted((r["text"] or "") for r in kept.collect()) == ["", "a", "b"]
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0


def test_index_follows_its_directory(spark, docs):
    """Buckets split only where they are overfull, every row lies in the file of its bucket, and owners are key ranges."""
    rows = docs.select("doc_id", "text").union(frame(spark, [(20_000 + i, "the same") for i in range(100)]).select("doc_id", "text"))
    index, directory = exact_dedup.index_of(rows, bucket_rows=16)
    leaves = {r["bucket"]: r for r in directory.collect()}
    found = index.withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), r"bucket=(\d+)/", 1).cast("long")).collect()
    assert len(found) == rows.count()
    held = collections.Counter(r["bucket"] for r in found)
    keys = collections.defaultdict(set)
    for r in found:
        leaf = leaves[r["bucket"]]
        bits = r["h"] % 2**64
        assert r["file"] == r["bucket"] and bits >> (64 - leaf["depth"]) == leaf["prefix"]
        keys[r["bucket"]].add(r["h"])
        if r["parts"] == 1:
            assert r["owner"] == leaf["owner"]
    assert all(held[b] == leaf["rows"] and (leaf["rows"] <= 16 or len(keys[b]) == 1) for b, leaf in leaves.items())
    depth = max(leaf["depth"] for leaf in leaves.values())
    order = sorted(leaves.values(), key=lambda x: x["prefix"] << (depth - x["depth"]))
    assert [x["bucket"] for x in order] == list(range(1, len(order) + 1)) and [x["owner"] for x in order] == sorted(x["owner"] for x in order)
    start = min(x["depth"] for x in order)
    rows_below = lambda d, p: sum(x["rows"] for x in order if x["depth"] >= d and x["prefix"] >> (x["depth"] - d) == p)
    assert all(rows_below(x["depth"] - 1, x["prefix"] >> 1) > 16 for x in order if x["depth"] > start)
    cut = [r for r in found if r["parts"] > 1]
    assert len(cut) == 100 and max(collections.Counter(r["part"] for r in cut).values()) <= 32


def grams(t, n=5):
    w = WORD.findall(t or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_join(rows, threshold=0.8):
    sets = [(i, grams(t)) for i, t in rows]
    linked = [[j for j, (_, b) in enumerate(sets) if j != k and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for k, (_, a) in enumerate(sets)]
    root = list(range(len(sets)))
    for _ in sets:
        for k, own in enumerate(linked):
            root[k] = min([root[k], *(root[j] for j in own)], key=lambda j: (rows[j][0], j))
    return collections.Counter((i, sets[root[k]][0], len(linked[k])) for k, (i, _) in enumerate(sets))


def test_jaccard_join_on_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    found = near_join.jaccard_join(docs).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == plain_join(rows)


@pytest.mark.parametrize("bounds", [{}, {"block_nodes": 7}, {"block_grams": 300}])
def test_jaccard_join_of_blocks(spark, bounds):
    """A group of near copies that is cut into blocks, exact copies, and texts without or with few words."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(3)] + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one  two"), (205, "one"), (206, " ".join(f"z{i}" for i in range(30_000)))]
    found = near_join.jaccard_classes(frame(spark, rows), **bounds).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == plain_join(rows)
    left = near_join.one_per_class(frame(spark, rows))
    assert left.columns == frame(spark, []).columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({k for _, k, _ in plain_join(rows)})
    assert near_join.jaccard_join(frame(spark, []), ).count() == 0


@pytest.mark.parametrize("build", [near_join.jaccard_join, lambda d: pii.redact_personal_data(d, model=object()), lambda d: packing.pack_documents(d, public_tokenizers.path("word_bpe_49k.json"))])
@pytest.mark.parametrize("bound", ["64m", "67108864b", "1m"])
def test_arrow_batches_are_bounded(spark, build, bound):
    """What an operator on texts has planned gets them in small batches: at most one row beyond the bound; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, bound)
        build(frame(spark, []))
        rows = spark.range(0, 160, 1, 1).select("id", F.repeat(F.lit("x"), 50_000).alias("text"))
        sizes = rows.mapInArrow(lambda stream: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in stream), "n long").collect()
    finally:
        spark.conf.set(name, before)
    assert sum(r["n"] for r in sizes) == 160
    assert max(r["n"] for r in sizes) <= (2 << 20 if bound != "1m" else 1 << 20) // 50_000 + 1


def test_links_of_block_pairs_are_summed(spark, monkeypatch):
    """Of a group that is cut into blocks, the saved links have one row for each node and root, not one for each block pair."""
    kept, saved = {}, near_join.common.saved

    def keep(df, name, by=None):
        kept[name] = saved(df, name, by)
        return kept[name]

    monkeypatch.setattr(near_join.common, "saved", keep)
    rows = [(i, " ".join([f"w{k}" for k in range(119)] + [f"x{i}"])) for i in range(40)]
    found = near_join.jaccard_classes(frame(spark, rows), block_nodes=7).collect()
    assert {(r["class_id"], r["n_links"]) for r in found} == {(0, 39)}
    links = kept["near-links"]
    assert links.filter("split").count() > 0
    assert links.count() == links.select("key", "root", "split").distinct().count()


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.9):
        bands, rows = near_join.bands_for(threshold, 0.999, 64)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 105), (105, 103), (7, 7), (200, 201)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 61)} == {1} and {found[i] for i in (100, 103, 105)} == {100} and found[201] == 200
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_stats(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, labels):
    more = frame(spark, [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "a b a b a b\n\na b a b a b"), (-5, "x y z " * 9000), (-6, "\U0001f600 # 　 a")]).select("doc_id", "text")
    rows = docs.select("doc_id", "text").union(more)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    found = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(rows, labels).collect()}
    assert len(found) == len(texts)
    for i, r in found.items():
        known = plain_stats(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == known
        assert r["base_failed"] == (known[0] < 50 or 100 * known[4] > 50 * known[0]) and not (r["base_failed"] and r["kept"])
    judged = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if not found[r["doc_id"]]["base_failed"]]
    assert sum(r["kept"] == (q == 1) for r, q in judged) >= 0.9 * len(judged)


def test_rare_kinds_get_rules_of_their_own(spark):
    """Symbol-heavy and all-short-word texts are each 3 % of the unwanted documents and lie outside the wanted ones."""
    stats, labels = [], []
    for i in range(1860):
        kind = "wanted" if i < 900 else "usual" if i < 1800 else "symbols" if i % 2 else "short"
        symbols, repeated = 40 if kind == "symbols" else i * 7 % 11, 45 if kind == "usual" else i * 5 % 13
        chars = 150 if kind == "short" else 400 + i * 3 % 101
        stats.append((i, 100, chars, 60 + i % 17, repeated, 10, 0, symbols, i % 9, i % 3))
        labels.append((i, int(kind == "wanted")))
    columns = "doc_id long, n_words long, word_chars long, n_distinct long, n_repeat_words long, n_lines long, n_dup_lines long, n_symbols long, n_upper long, n_exclaim long"
    table = spark.createDataFrame(stats, columns)
    rules = quality_rules.learn_rules(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r["doc_id"] for r in table.filter(quality_rules.verdict(rules)).collect()}
    assert kept == set(range(900)), [list(map(str, r)) for r in rules]


def test_quality_rules_without_labels(spark, labels):
    rows = frame(spark, [(1, "word other " * 10 + " ".join(map(str, range(100)))), (2, None)])
    found = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.apply_quality_rules(rows, labels.limit(0)).collect()}
    assert found == {1: (False, True), 2: (True, False)}
    assert quality_rules.apply_quality_rules(rows.limit(0), labels).count() == 0


def test_classifier_on_held_out_labels(docs, labels):
    found = {r["doc_id"]: r for r in quality_gbt.classify_quality(docs, labels).collect()}
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found.values())
    held = [(found[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert len(held) > 10 and sum(p == q for p, q in held) >= 0.9 * len(held)


def test_classifier_of_odd_rows(spark, labels):
    rows = frame(spark, [(1, None), (2, ""), (None, "a b"), (3, "w " * 50_000), (3, "w " * 50_000)])
    found = quality_gbt.classify_quality(rows, labels).collect()
    assert len(found) == 5 and len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    assert quality_gbt.classify_quality(rows.limit(0), labels.limit(0)).count() == 0


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality_gbt.fit_forest(x, y, trees=30)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95
    raw = []
    for row in x:
        total = forest.prior
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            i = 0
            while i < len(feature):
                i = 2 * i + 1 + int(row[feature[i]] > threshold[i])
            total += leaf[i - len(feature)]
        raw.append(total)
    assert np.allclose(raw, forest.raw(x))


def test_pipeline_stages(spark, docs, labels, sf_dir):
    columns, now = docs.columns, docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.saved(stage(spark, now, sf_dir), name)
        assert now.columns == columns
        sizes.append(now.count())
        if name == "quality_classifier":
            bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
            good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
            left = {r["doc_id"] for r in now.select("doc_id").collect()}
            assert len(good & left) >= 0.95 * len(good) and len(bad & left) <= 0.1 * len(bad)
        if name == "exact_dedup":
            own = plain_copies([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert {r["doc_id"] for r in now.collect()} == {k for k, _, _ in own.values()}
        if name == "ngram_jaccard_join":
            own = plain_join([tuple(r) for r in before.select("doc_id", "text").orderBy("doc_id").collect()])
            assert {r["doc_id"] for r in now.collect()} == {k for _, k, _ in own}
        if name == "personal_data":
            assert sizes[-1] == sizes[-2]
            was = {r["doc_id"]: r["text"] for r in before.collect()}
            same = [r["text"] == pii.redacted(text, pii.base_spans(text)) for r in now.collect() if (text := was[r["doc_id"]]) is not None]
            assert same.count(False) <= 0.001 * len(same)  # the field adds next to nothing here
            assert now.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    assert sizes == sorted(sizes, reverse=True)
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().count() == sizes[-1]


def test_pipeline_of_odd_rows(spark, docs, labels, tmp_path):
    """Null ids and texts, repeated rows, no labels, and empty tables."""
    few = docs.orderBy("doc_id").limit(12)
    odd = few.union(few.limit(3)).union(few.limit(1).withColumn("text", F.lit(None).cast("string"))).union(few.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for name, rows, marks in (("odd", odd, labels.limit(0)), ("none", docs.limit(0), labels.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        marks.write.parquet(str(tmp_path / name / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(found) == (name == "odd")
        if name == "odd":
            texts = {r["text"] or "" for r in odd.collect()}
            assert len({(r["doc_id"], r["ids_crc32"]) for r in found if r["start"] == 0}) <= len(texts)


def test_one_class_of_labels_keeps_all(spark, docs, labels):
    for marks in (labels.filter("quality = 0"), labels.filter("quality = 1"), labels.limit(0)):
        assert quality_gbt.keep_good(docs, marks).count() == docs.count()
