"""Token alignment, nearest neighbours and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trailhound.llm import align, ann, queries, spelling
from trailhound.llm.piece import piece_path
from trailhound.llm.tokens import byte_bpe_path, load_tokenizer

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# ---- op11 -----------------------------------------------------------------------------

def plain_neighbours(rows, k):
    """{query_id: [(score, vec_id)]} of rows that take part, each (vec_id, vector) once."""
    good = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[vec_id, tuple(v)] = np.array(v, dtype=np.float32).astype(float)
    sizes = Counter(len(v) for v in good.values())
    size = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    good = {key: v for key, v in good.items() if len(v) == size}
    out = defaultdict(list)
    for query, v in good.items():
        if query[0] % 100 == 0:
            out[query[0]] += sorted((float(np.sqrt(((w - v) ** 2).sum())), row[0]) for row, w in good.items() if row != query)[:k]
    return dict(out)


def found_neighbours(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return dict(out)


def recall(found, want):
    return np.mean([len({i for _, i in found[q]} & {i for _, i in want[q]}) / max(1, len(want[q])) for q in want])


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, ids string")


def test_neighbours_of_many_lists_are_found(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16)) * 2
    rows = [(i, (centres[i % 20] + rng.normal(size=16)).tolist()) for i in range(4000)]
    rows += [(4000 + i, rows[7][1]) for i in range(1500)]  # one common vector
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "CELL_ROWS", 40)  # lists in several parts
    monkeypatch.setattr(ann, "CELL_QUERIES", 3)
    found, want = found_neighbours(ann.nearest_neighbours(vectors(spark, rows))), plain_neighbours(rows, 10)
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    assert recall(found, want) >= 0.9
    plain = dict(rows)
    for q, hits in found.items():
        assert hits == sorted(hits)
        for d, i in hits:
            v, w = (np.array(plain[x], dtype=np.float32).astype(float) for x in (q, i))
            assert abs(d - np.sqrt(((v - w) ** 2).sum())) < 1e-12


def test_few_rows_are_searched_whole_and_odd_ones_left_out(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [0.0, 1.0]), (5, [1.0, 0.0]),
        (3, None), (4, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]),
        (None, [1.0, 1.0]), (100, [2.0, 0.0]), (100, [0.0, 2.0]), (200, []), (300, [1.0, 2.0, 3.0]),
    ]
    found, want = ann.nearest_neighbours(vectors(spark, rows), k=3), plain_neighbours(rows, 3)
    assert sorted(r["rank"] for r in found.collect() if r["query_id"] == 100) == [1, 1, 2, 2, 3, 3]  # asked with each vector
    found = found_neighbours(found)
    assert {q: sorted(v) for q, v in found.items()} == {q: sorted(v) for q, v in want.items()}
    assert found[0] == [(0.0, 1), (0.0, 5), (0.5, 2)]
    double = found_neighbours(ann.nearest_neighbours(vectors(spark, [(0, [1.0, 1e-9]), (1, [1.0, 0.0])], "double")))
    assert double[0][0][0] == pytest.approx(1e-9, rel=1e-6)
    assert ann.nearest_neighbours(vectors(spark, [])).count() == 0
    assert ann.nearest_neighbours(vectors(spark, [(0, [1.0])])).count() == 0


def test_a_query_in_a_small_far_list_still_finds_k(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 900) if i % 100] + [(0, [500.0] * 8), (950, [500.5] * 8)]
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    found = found_neighbours(ann.nearest_neighbours(vectors(spark, rows)))
    want = plain_neighbours(rows, 10)
    assert [i for _, i in found[0]] == [i for _, i in want[0]]
    assert [d for d, _ in found[0]] == pytest.approx([d for d, _ in want[0]])


def test_the_graph_reaches_all_heads_and_cells_are_balanced():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(300, 8)), 50 + 0.01 * rng.normal(size=(300, 8))])
    cells = ann.balanced_cells(points, 37)
    assert sorted(np.concatenate(cells).tolist()) == list(range(600))
    assert max(map(len, cells)) - min(map(len, cells)) <= 2
    heads = ann.Heads.build(points, 600 * ann.LIST_ROWS, 10, 1.1)
    plain = np.sqrt(((points[:, None] - heads.points[None]) ** 2).sum(2))
    row, leaf = heads.place(points)
    home = {r: l for r, l in zip(row[::-1].tolist(), leaf[::-1].tolist())}
    assert np.mean([plain[r, home[r]] <= plain[r].min() + 1e-3 for r in range(600)]) > 0.95
    assert len(set(zip(row.tolist(), leaf.tolist()))) == len(row) > 600  # boundary vectors in several lists


def test_the_query_has_recall_on_the_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = found_neighbours(queries.op11_nearest_neighbours(spark, SMALL))
    assert recall(found, plain_neighbours(rows, 10)) >= 0.9


# ---- op12 -----------------------------------------------------------------------------

def plain_alignment(rows):
    tokenizer = load_tokenizer(byte_bpe_path())
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    char_of = align.bytes_to_chars()
    a_bytes = {i: bytes(char_of[c] for c in p) for p, i in tokenizer.get_vocab().items() if all(c in char_of for c in p)}

    def b_bytes(i):
        piece = other.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def spans(ids, of):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at = out[-1][1]
        return out

    texts, counts = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = other.encode(text) if text else []
        if not text or b"".join(a_bytes[i] for i in a) != raw or b"".join(map(b_bytes, b)) != raw:
            texts.append((doc_id, 0, 0, 0, [], ""))
            continue
        a, b = spans(a, a_bytes.__getitem__), spans(b, b_bytes)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, begin = [], 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            sides = (",".join(str(x[2]) for x in side if begin < x[1] <= end) for side in (a, b))
            groups.append("|".join(sides))
            begin = end
        counts.update(set(links))
        texts.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return Counter(
        (d, na, nb, ng, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), sha)
        for d, na, nb, ng, links, sha in texts
    )


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

ODD_TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "\nb", "b\n", "tab\tand\r\nfeed", "▁ mark", "x▁y",
    "<s> </s> <unk> <0x41> <|endoftext|>", "naïve été \U0001f600\U0001f600 你好", "aaaa aaaaa", "\x00\x01", "can't won't it's",
    "12345 67,890.12", " nbsp em", "é combining", "A" * 700, "word " * 300, "...!!!??", "﻿bom", "สวัสดี",
]


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_alignment_agrees_with_a_plain_version(spark, block_bytes):
    rng = random.Random(4)
    alphabet = "aab bc the \n.,é▁\t'你X1"
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += [(1, "the stone walks"), (1, "the stone walks"), (None, "the stone walks"), (7, None)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], DOCS + ", pairs int").repartition(3)
    found = align.align_tokens(df, block_bytes=block_bytes)
    assert Counter(tuple(r) for r in found.select(*ALIGNED).collect()) == plain_alignment(rows)


def test_alignment_forgets_and_learns_chunks_again(spark, monkeypatch):
    rows = [(i, f"stone{i % 50} river{i % 7} the{i}") for i in range(300)]
    aligner = align.Aligner(byte_bpe_path(), piece_path())
    monkeypatch.setattr(align, "MEMO_CHUNKS", 5)
    generations = set()
    for at in range(0, 300, 20):
        texts = [t for _, t in rows[at:at + 20]]
        found, own = aligner.numbers(texts), aligner.records
        generations.add(id(own))
        for text, numbers in zip(texts, found):
            whole = aligner._whole(text)
            assert ";".join(own.groups[n] for n in numbers) == own.groups[whole]
            assert b"".join(own.pairs[n] for n in numbers) == own.pairs[whole]
            for counts in (own.n_a, own.n_b, own.n_groups):
                assert sum(counts[n] for n in numbers) == counts[whole]
        assert len(own.number) < 100
    assert len(generations) > 2


def test_alignment_of_a_long_text_and_of_none(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(20_000))
    rows = [(1, text), (2, "no" * 30_000)]
    found = align.align_tokens(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_a", "n_b", "groups_sha256").collect()
    aligner = align.Aligner.of(byte_bpe_path(), piece_path())
    for r in found:
        whole = aligner._whole(dict(rows)[r["doc_id"]])
        own = aligner.records
        groups = own.groups[whole]
        assert (r["n_a"], r["n_b"], groups.count(";") + 1) == (own.n_a[whole], own.n_b[whole], own.n_groups[whole])
        assert r["groups_sha256"] == hashlib.sha256(groups.encode()).hexdigest()
    assert align.align_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_the_alignment_query_agrees_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r["text"] or "") < 4000]
    df = spark.createDataFrame(rows, DOCS)
    assert Counter(tuple(r) for r in align.align_tokens(df).select(*ALIGNED).collect()) == plain_alignment(rows)
    assert queries.op12_token_alignment(spark, SMALL).count() == 200


# ---- op13 -----------------------------------------------------------------------------

def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            near[w] |= holes[i, short] - {w}
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def worn(rng, word):
    at, c = rng.randrange(len(word)), rng.choice("abcdré×")
    return rng.choice([word[:at] + word[at + 1:], word[:at] + c + word[at + 1:], word[:at] + c + word[at:]])


@pytest.mark.parametrize("cell_words", [4, 100_000])
def test_variants_agree_with_a_plain_version(spark, cell_words, monkeypatch):
    monkeypatch.setattr(spelling, "PART_ROWS", 3 if cell_words == 4 else 65536)
    monkeypatch.setattr(spelling, "near_words", lambda words, f=spelling.near_words: f(words, cell_words))
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdr") for _ in range(rng.randint(7, 11))) for _ in range(30)] + ["Garçonne", "Étoilesÿ"]
    rows = []
    for i in range(250):
        text = " ".join(rng.choice(words[:10] * 6 + words) for _ in range(40))
        rows.append((i, text + " " + " ".join(worn(rng, worn(rng, rng.choice(words))) for _ in range(12))))
    rows += [(3, None), (None, "abcdabcd Abcdabcd abcdabcde"), (4, ""), (5, "12 ?"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS + ", word int").repartition(3)
    want = plain_variants(rows)
    assert variants(spelling.spelling_variants(df)) == want
    assert sum(v[0] is not None for v in want.values()) > 10


def test_chains_end_at_their_last_form_and_ties_at_the_first_word(spark):
    def say(word, n):
        return " ".join([word] * n)

    # Ids whose runs keep their letters, so that the counts are as said.
    def keeps(doc_id, words):
        return all(zlib.crc32(f"{doc_id}:{w}".encode()) % 31 for w in words)

    words = ["mountain", "mountaib", "mountaxb", "valleyab", "valleyac", "valleyaa", "abcdefg", "bacdefg"]
    doc_id = next(i for i in range(1000) if keeps(i, words))
    text = " ".join([say("mountain", 300), say("mountaib", 30), say("mountaxb", 3), say("valleyac", 40), say("valleyab", 40), say("valleyaa", 2), say("abcdefg", 90), say("bacdefg", 2)])
    got = variants(spelling.spelling_variants(spark.createDataFrame([(doc_id, text)], DOCS)))
    assert got["mountaxb"] == ("mountaib", "mountain", 3, 1, 30) and got["mountaib"][:2] == ("mountain", "mountain")
    assert got["valleyaa"] == ("valleyab", "valleyab", 2, 2, 40)
    assert got["valleyab"][:2] == (None, "valleyab") and got["bacdefg"] == (None, "bacdefg", 2, 0, None)


def test_variants_of_a_very_long_run_and_of_none(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long} {long}c {long}c"), (2, None)]
    assert variants(spelling.spelling_variants(spark.createDataFrame(rows, DOCS))) == {
        long: (None, long, 2, 1, None), long + "c": (None, long + "c", 2, 1, None),
    }
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_the_variant_query_agrees_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert variants(queries.op13_spelling_variants(spark, SMALL)) == plain_variants(rows)
