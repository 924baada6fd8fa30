"""Operators on single texts against plain versions: counts, spans, notices, tokens, chats."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailhound.llm import attribution, bottomk, chat, licenses, packing, pii, piece, quality, tokens

ODD = [None, "", " ", "\n", "x", "a  b", " a\n\n b ", "日本 語\u3000é", "\x00", "<|endoftext|> a", "İstanbul K"]


def made_texts(seed, n, parts, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)] + ODD


def frame(spark, texts):
    return spark.createDataFrame(
        [(i, t, "en", f"s{i % 2}", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, fp long")


# ---- op1 ------------------------------------------------------------------------------

def plain_counts(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    many = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in many for k in range(8)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, len(inside)


def test_counts_agree_with_regular_expressions():
    for text in made_texts(1, 400, ["a ", "b ", "\n", "é", "#", "\x1c", "\u2003", "a b a b a b a b "]):
        got = quality.text_counts(text)
        assert tuple(got[k] for k in quality.COUNTS[:5]) == plain_counts(text), text


# ---- op2, op8 ---------------------------------------------------------------------------

def test_memoized_ids_are_the_tokenizer_s():
    encoder = tokens.MemoEncoder(tokens.byte_bpe_path())
    texts = made_texts(2, 3000, list(" \n\tab,'s.é1") + ["  ", " \n", "\xa0", "word ", "日"])
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


def test_old_chunks_are_forgotten_without_changing_ids(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 5)
    encoder = tokens.MemoEncoder(tokens.byte_bpe_path())
    for text in ["a b c d e f g", "g f e d", "x y z a b c", "a b c"] * 2:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text).ids


def test_packs_hold_every_id_once(spark):
    texts = made_texts(3, 60, ["word ", "longer words here ", "\n", "é"], 400) + ["many words " * 3000]
    rows = packing.pack(frame(spark, texts)).toPandas()
    tokenizer = tokens.load_tokenizer(tokens.byte_bpe_path())
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].tobytes())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= packing.SEQUENCE_TOKENS
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]]


def test_histogram_packing_is_that_of_single_documents():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 200))]
        room: list[int] = []
        for length in sorted(lengths, reverse=True):
            most = max(room, default=0)
            if most >= length:
                room[room.index(most)] -= length
            else:
                room.append(64 - length)
        packs = packing.shortest_pack_first({n: lengths.count(n) for n in lengths}, 64)
        assert sorted(64 - r for r in room) == sorted(sum(p) for p, n in packs for _ in range(n))


def test_fields_get_the_tokens_that_lie_most_in_them(spark):
    texts = made_texts(5, 80, ["word ", "\n", "\n\n", "é", " \n", "日", "x\ny"], 30)
    got = attribution.attribute_tokens(frame(spark, texts)).toPandas()
    tokenizer = tokens.load_tokenizer(tokens.byte_bpe_path())
    for i, text in enumerate(texts):
        whole, names, ends = attribution.layout(f"s{i % 2}", "en", text)
        want, crossing = [0] * len(names), [0] * len(names)
        for a, b in tokenizer.encode(whole, add_special_tokens=False).offsets:
            share = [max(0, min(b, e) - max(a, s)) for s, e in zip([0, *ends], ends)]
            best = share.index(max(share))
            want[best] += 1
            crossing[best] += sum(x > 0 for x in share) > 1
        own = got[got.doc_id == i].sort_values("section")
        assert own.n_tokens.tolist() == want and own.n_crossing.tolist() == crossing
        assert own.field.tolist() == names and own.end.tolist() == ends


# ---- op9 --------------------------------------------------------------------------------

def test_piece_ids_are_the_library_s():
    codec = piece.Codec(piece.piece_path())
    texts = made_texts(6, 1500, list(" \n\tab,.é1") + ["  ", "<s>", "\u2581", "日本", "tion", "the ", "<0x41>"])
    for text, (ids, same) in zip(texts, codec.encode(texts)):
        numbers = np.frombuffer(ids, "<u4").tolist()
        assert same and numbers == codec.other.encode(text or "")
        assert codec.decode(ids) == codec.other.decode(numbers)
        assert codec.decode(ids) == codec.tokenizer.decode(numbers, skip_special_tokens=False)


def message(*parts):
    out = b""
    for number, value in parts:
        if isinstance(value, bytes):
            out += bytes([number << 3 | 2]) + bytes([len(value) & 127 | 128, len(value) >> 7]) + value
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += (bytes([number << 3]) if number < 16 else bytes([number << 3 & 127 | 128, number >> 4])) + bytes([value])
    return out


def test_unigram_models_are_rebuilt(tmp_path):
    import sentencepiece

    words = {"▁": -3.0, "a": -4.0, "b": -4.5, "ab": -5.0, "▁a": -4.2, "▁ab": -6.5, "ba": -6.0, "abb": -9.0}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(w, s, 1) for w, s in words.items()]]
    pieces += [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    codec = piece.Codec(str(path))
    assert isinstance(codec.other, sentencepiece.SentencePieceProcessor) and codec.spec.kind == piece.UNIGRAM
    texts = made_texts(7, 400, ["a", "b", "ab", " ", "é"], 12)
    for text, (ids, same) in zip(texts, codec.encode(texts)):
        assert same, text
        assert codec.decode(ids) == codec.other.decode(np.frombuffer(ids, "<u4").tolist())


def test_parity_is_of_whole_texts_and_of_their_decoding(tmp_path):
    from tokenizers import decoders

    words = {"▁": -3.0, "a": -4.0, "b": -4.5, "▁a": -4.2, "▁b": -4.4, "a▁b": -1.0}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(w, s, 1) for w, s in words.items()]]
    pieces += [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1), (35, 1))), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = str(tmp_path / "across.model")
    (tmp_path / "across.model").write_bytes(data)
    codec = piece.Codec(path)
    assert not codec.by_words and all(same for _, same in codec.encode(["a", "b", "a b"]))
    codec.by_words = True  # joining goes wrong where a piece reaches across a space
    assert [same for _, same in codec.encode(["a", "b", "a b"])] == [True, True, False]
    work = piece._RoundTrip(path)
    codec.by_words = False
    piece.Codec.made[path] = codec
    rows = {"doc_id": [0, 1, 2], "text": ["a a", "b", None]}
    assert work.start()(rows)["parity"] == [True, True, True]
    codec.tokenizer.decoder = decoders.Replace("b", "x")  # decoding goes wrong for one letter
    assert work.start()(rows)["parity"][1:] == [False, True]


# ---- op6 --------------------------------------------------------------------------------

def plain_spans(text):
    shapes = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for rank, (kind, shape) in enumerate(shapes.items()):
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            fits = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }
            if fits[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    parts = [*"0123456789.@+-() ab%", "4111 1111 1111 1111", "192.168.0.1", "a.b@c.de", "@", "..", "+1 (555) 010-9999", "x@y", "255.", "é"]
    for text in made_texts(8, 6000, parts, 14):
        assert [s for s in pii.find_spans(text) if s[1] < 4] == plain_spans(text), text


@pytest.mark.parametrize("text, kind, value", [
    ("see https://a.example/x?y=1.", "url", "https://a.example/x?y=1"),
    ("1." + "longer" * 10 + "+x://a.example", "url", "longer" * 10 + "+x://a.example"),
    ("İİ PassWord=abc12345x", "secret", "abc12345x"), ("ApI_kEy: k3y-value-x", "secret", "k3y-value-x"),
    ("IBAN: GB82 WEST 1234 5698 7654 32 ok", "account", "GB82 WEST 1234 5698 7654 32"),
    ("SSN 123-45-6789.", "account", "123-45-6789"),
    ("account number: 00123456", "account", "00123456"),
    ("password=e9b9ed9cc999 x", "secret", "e9b9ed9cc999"),
    ('token = "0641917ea4e9feb9cda8" x', "secret", "0641917ea4e9feb9cda8"),
])
def test_cues_and_schemes_are_expanded(text, kind, value):
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.find_spans(text) if k >= 4]
    assert found == [(kind, value)]
    assert pii.mask(text) == text.replace(value, f"<{kind.upper()}>")


def test_ordinary_words_are_no_spans():
    for text in ("the account of a token of trust", "IBAN: GB82 WEST 1234 5698 7654 33", "mypassword=abc12345x", "a:// b", "password is good"):
        assert pii.find_spans(text) == []


def test_span_digest_and_masked_columns(spark):
    docs = frame(spark, ["a b@c.de 1.2.3.4", None, ""])
    row, none, empty = pii.digest(pii.personal_data(docs)).orderBy("doc_id").collect()
    assert row.spans == "email:2:8,ip:9:16" and row.base_sha256 == hashlib.sha256(row.spans.encode()).hexdigest()
    assert none.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.mask_documents(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert masked.columns == [*docs.columns, "n_chars"]
    assert [(r.text, r.n_chars, r.fp) for r in masked.orderBy("doc_id").collect()] == [("a <EMAIL> <IP>", 14, 0), (None, None, 1), ("", 0, 2)]


# ---- op7 --------------------------------------------------------------------------------

def test_license_join_finds_what_counting_finds(spark):
    notices = [n + " " for n in licenses.NOTICES] + [p + " " for p in licenses.PHRASES]
    some = [w + " " for n in licenses.NOTICES for w in n.split()]
    texts = made_texts(9, 150, notices + some * 2 + ["x "] * 200 + ["CC-BY\n", "ÉA "], 120)
    docs = frame(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = {r[0]: r for r in con.execute(licenses.oracle_sql()).fetchall()}
    names = [d[0] for d in con.description]
    for row in licenses.digest(licenses.scan_licenses(docs)).collect():
        assert tuple(row[n] for n in names) == want[row.doc_id], texts[row.doc_id]


def test_spread_notices_and_long_templates_are_found_at_every_offset(spark):
    spread = [n for n in licenses.NOTICES if len(n.split()) in range(10, 16)]
    long = max(licenses.NOTICES, key=len)
    texts = []
    for notice in spread:
        words = "".join(c if c.isalnum() else " " for c in notice).split()
        gaps = min(4, 64 // len(words) - 1)
        texts += [("pad " * offset + " ".join(w + " zz" * gaps for w in words), licenses.NOTICES[notice]) for offset in range(32)]
    tail = long.split()[len(long.split()) // 6:]  # without its opening words
    texts += [("pad " * offset + " ".join(tail), licenses.NOTICES[long]) for offset in (0, 1, 31, 500)]
    joiner = licenses.Joiner(licenses.built_in_templates(), {})
    for text, label in texts:
        assert label in joiner.scan(text)[2] | {x for _, x in joiner.scan(text)[1]}, text
    assert joiner.scan("pad " * 200_000 + long)[2] >= {licenses.NOTICES[long]}  # a very long text
    none = spark.createDataFrame([], "doc_id long, text string, places string")
    assert licenses.digest(licenses.scan_licenses(none)).count() == 0


# ---- op4 --------------------------------------------------------------------------------

def test_chats_read_back_as_they_were(spark):
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "</s>\n", " [/INST]\n", "<", "s>", "[", "/INST]", "a", "é", "$1", "<\\/s>"]
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[INST]\\", None]), x)
            for c in range(60) for t, x in enumerate(rng.sample(made_texts(c, 8, parts, 8), 6))]
    rows += [(None, 1, "user", "a"), (7, None, "user", "b"), (7, 0, "user", "same"), (7, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("output", F.lit(1))
    formatted = chat.format_conversations(table)
    runs = {r.conv_id: r.runs for r in chat.loss_runs(formatted).collect()}
    output = {r.conv_id: r.output for r in formatted.collect()}
    for row in chat.read_back(formatted).collect():
        own = sorted([(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == row.conv_id], key=lambda x: (x[0] is not None, x))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (row.n_turns, row.loss_chars, row.loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        at, under = 0, ""
        for run in runs[row.conv_id]:
            under += output[row.conv_id][at:at + run.length] if run.loss else ""
            at += run.length
        assert at == row.formatted_chars == len(output[row.conv_id])
        assert re.sub(r"\\(\\?)", r"\1", under) == loss
        assert len(re.findall(r"</s>", output[row.conv_id])) == len(own)


# ---- op5 --------------------------------------------------------------------------------

def plain_sketch(text, k=bottomk.K):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if not words:
        return []

    def chained(group):
        h = 42
        for w in group:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h >> 4

    return sorted({chained(words[i:i + 5]) for i in range(max(1, len(words) - 4))})[:k]


def shingle_set(text):
    words = (text or "").split()
    return {tuple(words[i:i + bottomk.WORDS]) for i in range(max(1, len(words) - bottomk.WORDS + 1))} if words else set()


def test_containment_and_distinct_counts_against_sets(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 60))) for _ in range(30)] + ["", None]
    texts += [" ".join(rng.choice("abcdefghijkl") for _ in range(3000)) for _ in range(6)]
    texts.append(texts[-1] + " " + texts[-2])
    pairs = [(i, a, rng.choice(texts[:32] if i < 32 else texts[32:])) for i, a in enumerate(texts)] + [(99, texts[-2], texts[-1])]
    df = spark.createDataFrame(pairs, "i int, a string, b string").withColumns({c: bottomk.sketch(F.col(c)) for c in ("a", "b")})
    got = {r.i: r for r in df.select("i", bottomk.distinct_shingles(F.col("a")).alias("n"), bottomk.containment(F.col("a"), F.col("b")).alias("c")).collect()}
    for i, a, b in pairs:
        one, other = shingle_set(a), shingle_set(b)
        share = len(one & other) / len(one) if one else 1.0
        if len(one | other) <= bottomk.K:
            assert got[i].n == len(one) and got[i].c == pytest.approx(share)
        else:
            assert got[i].n == pytest.approx(len(one), rel=0.35) and got[i].c == pytest.approx(share, abs=0.25)


def likeness(a, b, k=bottomk.K):
    if not a and not b:
        return 1.0
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union)


def test_sketches_and_edited_texts(spark):
    rng = random.Random(11)
    texts = made_texts(11, 40, [f"w{i} " for i in range(60)] + ["é\n"], 500)
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("fp", F.lit(1))
    order = sorted(zip(ids, texts))
    hexed = lambda s: "".join(f"{h:015x}" for h in s)
    rows = {r.doc_id: r for r in bottomk.fingerprint_pairs(docs).collect()}
    assert len(rows) == len(texts)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        t, n = text or "", after or ""
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        a, b = plain_sketch(t), plain_sketch(edited)
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == hexed(a) and r.edited_fingerprint == hexed(b)
        assert abs(r.near_edited - likeness(a, b)) < 1e-12 and abs(r.near_next - likeness(a, plain_sketch(n))) < 1e-12


def test_merged_parts_are_the_sketch_of_the_whole(spark):
    parts = spark.createDataFrame([("x", [1, 3, 5]), ("x", [2, 3]), ("y", [9]), ("y", [])], "key string, sketch array<long>")
    got = {r.key: r.sketch for r in bottomk.merge(parts, ["key"], k=3).collect()}
    assert got == {"x": [1, 2, 3], "y": [9]}


def test_one_document_follows_itself_and_repeated_ids_stay(spark):
    one = bottomk.fingerprint_pairs(spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")).collect()
    assert [(r.near_edited > 0, r.near_next) for r in one] == [(False, 1.0)] or one[0].near_next == 1.0
    many = bottomk.fingerprint_pairs(spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "x"), (6, None)], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in many) == ["5", "5", "6", "None"]


@pytest.mark.parametrize("operator", [
    packing.pack, pii.personal_data, licenses.scan_licenses, attribution.attribute_tokens, piece.round_trip,
    bottomk.fingerprint_pairs, quality.judge_quality])
def test_empty_tables_give_empty_results(spark, operator):
    assert operator(frame(spark, ["a"]).limit(0)).count() == 0
