"""Operators over whole tables against plain versions, and the pipeline over its stages."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trailhound.llm import pii, quality, simhash, toxicity
from trailhound.session import materialize

SMALL = "/root/testdata/sf0.001"


# ---- op1 ------------------------------------------------------------------------------

def sentence(rng, n, extra=""):
    return " ".join(rng.choice(["the", "stone", "river", "a", "walks", "green", "of", "light"]) + str(rng.randint(10, 99)) * (rng.random() < 0.2) + extra for _ in range(n))


def plain_verdicts(vectors, share, steps, tail):
    """The same estimate for one group, in numpy."""
    x = np.array(vectors)
    floor = np.array(list(quality.FLOOR.values())) * quality.UNIT
    centre = np.median(x, axis=0)
    low, high = np.quantile(x, [0.25, 0.75], axis=0)
    inverse = np.diag(1 / (((high - low) / 1.349) ** 2 + floor ** 2))

    def core(centre, inverse):
        d = x - centre
        bins = np.floor(np.log2(1 + np.einsum("ni,ij,nj->n", d, inverse, d)) * 8).astype(int)
        want, edge = math.ceil(len(x) * share), None
        for b in sorted(set(bins)):
            edge = b
            if np.sum(bins <= b) >= want:
                break
        return bins <= edge, edge

    for _ in range(steps):
        own = x[core(centre, inverse)[0]]
        centre = own.mean(axis=0)
        inverse = np.linalg.inv(own.T @ own / len(own) - np.outer(centre, centre) + np.diag(floor ** 2))
    scale = max(1.0, (2 ** ((core(centre, inverse)[1] + 1) / 8) - 1) / quality.chi2_point(1 - share, quality.DIM))
    d = x - centre
    return np.einsum("ni,ij,nj->n", d, inverse, d) / scale


def test_estimates_agree_with_a_plain_version_and_reject_what_is_far(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        text = sentence(rng, rng.randint(30, 80))
        if i % 24 == 5:
            text = sentence(rng, 50, "%%%") if i % 48 == 5 else text.upper() + "!!"
        rows.append((i, text, "en", None if i < 200 else f"rare{i % 3}"))
    rows += [(900, None, None, None), (901, "", "en", None), (902, "few words", "xx", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("pool", F.lit("x"))
    got = {r.doc_id: r for r in quality.judge_quality(docs, least=100).collect()}
    assert len(got) == len(rows)
    counted = spark.createDataFrame([quality.text_counts(t) for _, t, _, s in rows[:200]])
    vectors = [[*r] for r in counted.select(*quality.vector()).collect()]
    want = plain_verdicts(vectors, quality.CORE_SHARE, quality.STEPS, quality.TAIL)
    assert np.allclose([got[i].distance2 for i in range(200)], want)
    assert [i for i in range(200) if not got[i].kept] == [i for i in range(200) if i % 24 == 5]
    assert all(got[i].distance2 is None and got[i].kept for i in range(200, 240))  # too few for an estimate
    assert all(got[i].base_failed and not got[i].kept for i in (900, 901, 902))


def test_copies_of_junk_are_rejected_up_to_nearly_half_of_a_group(spark):
    rng = random.Random(3)
    junk, rows = "$$$ %%% costs 100% || $$ now $$ " + sentence(rng, 40, "%"), []
    for lang, percent in (("aa", 26), ("bb", 35), ("cc", 45)):
        rows += [(junk if i < 3 * percent else sentence(rng, rng.randint(30, 80)), lang, "s") for i in range(300)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in got if not got[i].kept] == [i for i in got if rows[i][0] == junk]


def test_each_statistic_alone_rejects_its_extreme(spark):
    rng = random.Random(4)
    base = ["the", "stone", "river", "a", "walks", "green", "of", "light"]
    some = [f"{a}{b}" for a in base for b in ("", "s", "ed")]
    kept = [" ".join(rng.choices(some, k=rng.randint(40, 80))) for _ in range(300)]
    words = rng.choices(some, k=100)
    extreme = {
        "word_length": " ".join(w * 4 for w in words), "symbols": " ".join(w + "$%" for w in words),
        "repeated_lines": "\n".join(rng.choice(some) for _ in range(600)),
        "capitals": " ".join(words).upper(), "punctuation": " ".join("." * len(w) for w in words),
        "digits": " ".join("".join(rng.choice("0123456789") for _ in w) for w in words),
        "echoes": " ".join(w for w in (f"{a}{b}" for a in base for b in "bcdfg") for _ in range(7)),
        "repeated_words": " ".join(words[:69] + words[:31]),
    }
    texts = kept + list(extreme.values())
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    assert all(got[i].kept for i in range(300))
    for i, name in enumerate(extreme, 300):
        assert not got[i].kept, name
        assert got[i].base_failed == (name == "repeated_words"), name
    point, limit = quality.chi2_point(quality.TAIL, quality.DIM), quality.MAX_REPEAT_PERCENT / 100
    assert all((1 / f) ** 2 > point for name, f in quality.FLOOR.items() if name not in ("word_length", "repeated_words"))
    assert 1 / quality.FLOOR["repeated_lines"] ** 2 + limit / quality.FLOOR["repeated_words"] ** 2 > point


def test_chi_square_points():
    assert quality.chi2_point(0.05, 3) == pytest.approx(7.815, abs=0.05)
    assert quality.chi2_point(0.001, 8) == pytest.approx(26.12, abs=0.3)


# ---- op3 --------------------------------------------------------------------------------

def test_marginals_are_those_of_all_tag_sequences():
    rng = np.random.default_rng(2)
    for sizes in ([1], [3, 1, 4], [5, 5], [40, 3]):
        n = sum(sizes)
        s, trans, start = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=2)
        first = toxicity._firsts(np.array(sizes))
        p, steps = toxicity.forward_backward(s, first, trans, start)
        at, total = 0, np.zeros((2, 2))
        for size in sizes:
            if size > 10:
                at += size
                continue
            weights = {}
            for tags in itertools.product((0, 1), repeat=size):
                w = start[tags[0]] + sum(trans[a, b] for a, b in zip(tags, tags[1:])) + sum(s[at + i] for i, t in enumerate(tags) if t)
                weights[tags] = math.exp(w)
            z = sum(weights.values())
            for i in range(size):
                assert p[at + i] == pytest.approx(sum(w for t, w in weights.items() if t[i]) / z)
            for tags, w in weights.items():
                for a, b in zip(tags, tags[1:]):
                    total[a, b] += w / z
            at += size
        if max(sizes) <= 10:
            assert np.allclose(total, steps)


def toxic_table(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(10, 60)).split()
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 4) * bad):
            words.insert(rng.randint(0, len(words)), rng.choice(["Grobble,", "snarfaly", "snarfend", "snarfing."]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame([*labels, (0, 1), (None, 1), (1, None)], "doc_id long, toxic int"))


def test_toxic_documents_and_their_spans_are_found(spark):
    docs, labels = toxic_table(spark)
    more = docs.unionByName(spark.createDataFrame([(1000, None, ""), (1001, "", ""), (1002, "A snarfold İ grobble", "")], docs.schema))
    rows = {r.doc_id: r for r in toxicity.toxicity(more, labels).collect()}
    assert len(rows) == 603
    texts = {r.doc_id: r.text for r in more.collect()}
    for i in range(600):
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == (i % 5 == 0), (i, r.score)
        marked = {texts[i][s.start:s.end].lower()[:5] for s in r.spans}
        assert marked == {w.lower()[:5] for w in texts[i].split() if w.lower()[:5] in ("grobb", "snarf")}
    assert rows[1000].score == rows[1001].score < 0.3
    assert rows[1002].predicted == 1 and [(s.start, s.end) for s in rows[1002].spans] == [(2, 10), (13, 20)]


def test_without_labels_all_scores_are_the_base_rate(spark):
    docs, labels = toxic_table(spark, 20)
    for known in (labels.limit(0), labels.filter("toxic = 0")):
        rows = toxicity.toxicity(docs, known).collect()
        assert len({r.score for r in rows}) == 1 and not any(r.predicted for r in rows)


def test_models_travel_as_bytes():
    model = toxicity.Model({"rate": np.array(0.1)})
    assert toxicity.Model.from_bytes(model.to_bytes()).score([None])[0].tolist() == [0.1]


# ---- op10 -------------------------------------------------------------------------------

def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = t.encode().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points, radius=3):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(points))]


def planted_points(n, seed):
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(points) < n:
        points.append(rng.choice(points) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}))
    return points


def test_routed_shards_miss_no_pair():
    points = planted_points(700, 4)
    array = np.array(points, dtype=np.uint64)
    at, seen = [], []
    for half in (0, 1):
        own = simhash.half_of(array, half)
        tree, leaves = simhash.build_tree(own[::3], 5, 1)
        assert leaves > 8
        row, leaf, home = simhash.route(tree, own, 1)
        assert sorted(row[home]) == list(range(len(points)))
        at.append(dict(zip(row[home], leaf[home])))
        seen.append(set(zip(row, leaf)))
    for i in range(len(points)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= 3:
                assert any((i, a[j]) in s or (j, a[i]) in s for a, s in zip(at, seen))


def test_pruned_search_finds_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 500)
    points = np.array(planted_points(500, 5), dtype=np.uint64)
    got = {(int(a), int(b)) for h in (0, 1) for i, j in simhash.near_pairs(points, points, h) for a, b in zip(i, j)}
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    assert got == set(zip(*map(list, np.nonzero(near))))


@pytest.mark.parametrize("shard, cell", [(2048, 8192), (40, 25)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, shard, cell):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    rng = random.Random(6)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(60)]
    texts = [None, "", "Two words", "two WORDS", "one"]
    for t in base:
        texts += [t, t.upper() if rng.random() < 0.3 else t]
        for _ in range(3):
            words = t.split()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    ids = rng.sample(range(10_000), len(texts))
    docs = spark.createDataFrame([*zip(ids, texts), (ids[0], texts[0])], "doc_id long, text string").withColumn("leaf", F.lit(1))
    order = sorted(zip(ids, texts))
    points = [plain_fingerprint(t) for _, t in order]
    roots = plain_components(points)
    want = {i: (f"{p:016x}", order[r][0]) for (i, _), p, r in zip(order, points, roots)}
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(set(roots)) < len(texts)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert simhash.near_duplicates(none).count() == 0
    assert toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


# ---- pipeline ---------------------------------------------------------------------------

def test_each_stage_decides_over_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append((name, docs))
        docs = materialize(stage(spark, docs, SMALL))
    texts = {name: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for name, d in inputs}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, d in inputs:
        assert d.columns == inputs[0][1].columns, name
        assert d.count() == len(texts[name])
    verdict = {r.doc_id for r in quality.judge_quality(inputs[0][1]).filter("kept").collect()}
    assert set(texts[names[1]]) == verdict and len(verdict) < len(texts[names[0]])
    order = sorted(texts[names[2]].items())
    roots = plain_components([plain_fingerprint(t) for _, t in order])
    assert set(texts[names[3]]) == {order[r][0] for r in roots}
    assert texts[names[4]] == {i: pii.mask(t) for i, t in texts[names[3]].items()}
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in packed} == set(texts[names[4]]) and all(r.n == r.t for r in packed)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = [
        (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "other text entirely here"), (4, None),
        (5, "a b c d e"), (5, "five has another text"), (2, "five has another text"), (5, "and a third one, too"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL)
    assert kept.columns == ["doc_id", "text", "fp"]
    # Rows of an id are held against their own groups: 5's first text goes with 3, its second with 2.
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [
        ("2", "five has another text"), ("3", "a b c d e"), ("4", "None"), ("5", "and a third one, too"), ("None", "other text entirely here")]
