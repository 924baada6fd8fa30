"""Toxic spans by a linear-chain conditional random field over two tags.

Training, in one task over a sample of bounded size (parameters below):
1. Labels are of documents, so tokens are labelled by distant supervision: words and word
   beginnings that stand in toxic documents so much more often than elsewhere that chance is
   ruled out over all candidates (binomial tail, Bonferroni) mark a toxic document's tokens.
2. The field gets, per token, weights of its word, its beginnings and ending, the words beside
   it, and weights of neighbouring tags; maximum likelihood by gradient ascent, where
   forward-backward gives the expected tags.
3. A logistic fit on all sampled documents turns marginals into a document score.

Scoring runs forward-backward over every token of every text. A batch is one chain that
starts anew at each document; chains are cut into blocks whose 2 x 2 matrices are multiplied
first, so that it is all array work whatever the lengths, with nothing left out.

Cases: a null or wordless text gets the score of a text without toxic tokens. Without
positive labels, or none that stand out, all scores are the base rate. Repeated labels of a
document count once (toxic if any is); null labels are none. Repeated rows stay.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from trailhound.llm.common import map_batches

#: Bounds of the training sample: labelled documents, and characters of each.
SAMPLE_DOCS = 4096
SAMPLE_CHARS = 20_000
#: Clean documents per toxic one from which the field learns; the score is fitted on all.
CLEAN_PER_TOXIC = 3
EPOCHS = 30
RATE = 0.3
DECAY = 1e-4
CHANCE = 0.01
BUCKETS = 1 << 18
THRESHOLD = 0.3
BLOCK = 32
MEMO_WORDS = 200_000
HELD_OUT = 2

_TO_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_WORDS).split()


@lru_cache(maxsize=1 << 16)
def word_features(word: bytes) -> list[bytes]:
    """The word, its beginnings and its ending."""
    chars = word.decode()
    return [b"w" + word, *(b"p%d" % n + chars[:n].encode() for n in (3, 4, 5, 6) if len(chars) > n), b"s" + chars[-3:].encode()]


def bucket(kind: bytes, feature: bytes) -> int:
    return zlib.crc32(kind + feature) % BUCKETS


def buckets_of(word: bytes) -> tuple[list[int], int, int]:
    return [bucket(b"0", f) for f in word_features(word)], bucket(b"-", word), bucket(b"+", word)


# ---- chains ---------------------------------------------------------------------------

def _scan(mats: np.ndarray, start: np.ndarray) -> np.ndarray:
    """start @ mats[0] @ ... @ mats[t] for every t, each scaled to sum 1."""
    n = len(mats)
    if n <= BLOCK:
        out, v = np.empty((n, 2)), start
        for t in range(n):
            v = v @ mats[t]
            v = v / v.sum()
            out[t] = v
        return out
    blocks = -(-n // BLOCK)
    padded = np.broadcast_to(np.eye(2), (blocks * BLOCK, 2, 2)).copy()
    padded[:n] = mats
    padded = padded.reshape(blocks, BLOCK, 2, 2)
    product = padded[:, 0]
    for t in range(1, BLOCK):
        product = _times(product, padded[:, t])
        product /= product.sum(axis=(1, 2), keepdims=True)
    before = np.empty((blocks, 2))
    before[0] = start
    before[1:] = _scan(product, start)[:-1]
    out = np.empty((blocks, BLOCK, 2))
    a, b = before[:, 0], before[:, 1]
    for t in range(BLOCK):
        m = padded[:, t]
        a, b = a * m[:, 0, 0] + b * m[:, 1, 0], a * m[:, 0, 1] + b * m[:, 1, 1]
        total = a + b
        a, b = a / total, b / total
        out[:, t, 0], out[:, t, 1] = a, b
    return out.reshape(-1, 2)[:n]


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    for i in (0, 1):
        for j in (0, 1):
            out[:, i, j] = x[:, i, 0] * y[:, 0, j] + x[:, i, 1] * y[:, 1, j]
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Marginals of tag 1, and the expected number of each step (i, j) within chains.

    scores: of tag 1 against tag 0 per token; first: where a chain begins; trans, start:
    log weights of a step and of a chain's first tag.
    """
    n = len(scores)
    weight = np.exp(np.clip(scores, -30, 30))
    mats = np.empty((n, 2, 2))
    mats[:] = np.exp(trans)
    mats[first] = np.exp(start)  # both rows: what was before does not matter
    mats[:, :, 1] *= weight[:, None]
    mats /= mats.sum(axis=(1, 2), keepdims=True)
    alpha = _scan(mats, np.array([0.5, 0.5]))
    beta = np.full((n, 2), 0.5)
    if n > 1:
        beta[:-1] = _scan(np.ascontiguousarray(mats[:0:-1].transpose(0, 2, 1)), np.array([0.5, 0.5]))[::-1]
    both = alpha * beta
    steps = alpha[:-1, :, None] * mats[1:] * beta[1:, None, :]
    steps /= steps.sum(axis=(1, 2), keepdims=True)
    return both[:, 1] / both.sum(axis=1), steps[~first[1:]].sum(axis=0)


# ---- training -------------------------------------------------------------------------

class Coded:
    """Documents as one run of word numbers, with where each begins."""

    def __init__(self, docs: list[list[bytes]]):
        code: dict[bytes, int] = {}
        self.ids = np.array([code.setdefault(w, len(code)) for d in docs for w in d], dtype=np.int64)
        self.words = list(code)
        self.sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.first = _firsts(self.sizes)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), dtype=bool)
    begins = np.cumsum(sizes) - sizes
    first[begins[sizes > 0]] = True
    return first


def telling_features(docs: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words and beginnings that mark toxic documents beyond chance.

    In toxic documents a feature counts once per word before it: copies of a document or a
    passage repeat their words in one setting and are no more evidence than one of them."""
    seen: dict[bytes, list[int]] = {}
    settings: set[tuple[bytes, bytes]] = set()
    for words, bad in zip(docs, toxic):
        mine: set[bytes] = set()
        for w, before in zip(words, [b"", *words]):
            for f in word_features(w):
                if f[:1] == b"s" or f in mine or (bad and (f, before) in settings):
                    continue
                mine.add(f)
                if bad:
                    settings.add((f, before))
        for f in mine:
            seen.setdefault(f, [0, 0])[int(bad)] += 1
    rate = toxic.mean() if len(toxic) else 0.0
    if not 0 < rate < 1 or not seen:
        return set()
    clean, bad = np.array(list(seen.values()), dtype=float).T
    share = bad / (bad + clean)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = share * np.log(share / rate) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
    # Mostly toxic, and rarer by chance than CHANCE over all the features looked at.
    good = (share > 0.9) & ((bad + clean) * kl > np.log(len(seen) / CHANCE))
    return {f for f, g in zip(seen, good) if g}


def _emission(coded: Coded, feats: list, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat, owner, prev, nxt = feats
    own = np.bincount(owner, weights[flat], minlength=len(coded.words))
    return own, weights[prev], weights[nxt]


def token_scores(ids: np.ndarray, first: np.ndarray, own, prev, nxt, bias: float) -> np.ndarray:
    scores = own[ids] + bias
    inner = ~first[1:]
    scores[1:] += np.where(inner, prev[ids[:-1]], 0.0)
    scores[:-1] += np.where(inner, nxt[ids[1:]], 0.0)
    return scores


def fit_field(docs: list[list[bytes]], toxic: np.ndarray) -> dict | None:
    """Weights of the field; None if nothing tells toxic documents apart."""
    telling = telling_features(docs, toxic)
    tags = [np.array([bool(bad) and any(f in telling for f in word_features(w)) for w in d], dtype=float) for d, bad in zip(docs, toxic)]
    positive = [i for i, t in enumerate(tags) if t.any()]
    if not positive:
        return None
    negative = [i for i, bad in enumerate(toxic) if not bad][: CLEAN_PER_TOXIC * len(positive)]
    chosen = positive + negative
    coded, y = Coded([docs[i] for i in chosen]), np.concatenate([tags[i] for i in chosen])
    made = [buckets_of(w) for w in coded.words]
    flat = np.array([b for m in made for b in m[0]])
    owner = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])
    prev, nxt = np.array([m[1] for m in made]), np.array([m[2] for m in made])
    ids, first, inner = coded.ids, coded.first, ~coded.first[1:]
    weights, bias, trans, start = np.zeros(BUCKETS), 0.0, np.zeros((2, 2)), np.zeros(2)
    held = np.full(BUCKETS, 1e-8)
    held_bias, held_trans, held_start = 1e-8, np.full((2, 2), 1e-8), np.full(2, 1e-8)
    seen_steps = np.array([[np.sum(inner & (y[:-1] == i) & (y[1:] == j)) for j in (0, 1)] for i in (0, 1)], dtype=float)
    seen_start = np.array([np.sum(first & (y == i)) for i in (0, 1)], dtype=float)
    scale, n = 1.0 / len(chosen), len(coded.words)
    for _ in range(EPOCHS):
        s = token_scores(ids, first, *_emission(coded, (flat, owner, prev, nxt), weights), bias)
        p, steps = forward_backward(s, first, trans, start)
        off = y - p
        per_word = np.bincount(ids, off, minlength=n)
        grad = np.bincount(flat, per_word[owner], minlength=BUCKETS)
        grad += np.bincount(prev, np.bincount(ids[:-1][inner], off[1:][inner], minlength=n), minlength=BUCKETS)
        grad += np.bincount(nxt, np.bincount(ids[1:][inner], off[:-1][inner], minlength=n), minlength=BUCKETS)
        grad = grad * scale - DECAY * weights
        held += grad * grad
        weights += RATE * grad / np.sqrt(held)
        g = off.sum() * scale
        held_bias += g * g
        bias += RATE * g / np.sqrt(held_bias)
        g = (seen_steps - steps) * scale
        held_trans += g * g
        trans += RATE * g / np.sqrt(held_trans)
        g = (seen_start - np.array([np.sum(1 - p[first]), np.sum(p[first])])) * scale
        held_start += g * g
        start += RATE * g / np.sqrt(held_start)
    return {"weights": weights.astype(np.float32), "bias": bias, "trans": trans, "start": start}


def document_features(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per document: log odds of the likeliest token, log of the expected toxic tokens, and of
    their share, as one rare word in a long text says less than in a short one."""
    begins = np.cumsum(sizes) - sizes
    most, total = np.zeros(len(sizes)), np.zeros(len(sizes))
    some = sizes > 0
    if some.any():
        most[some] = np.maximum.reduceat(p, begins[some])
        total[some] = np.add.reduceat(p, begins[some])
    most = np.clip(most, 1e-4, 1 - 1e-4)
    share = np.log((total + 0.05) / (sizes + 5))
    return np.column_stack([np.ones(len(sizes)), np.log(most / (1 - most)), np.log1p(total), share])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small ridge, the constant left free."""
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep
        step = np.linalg.solve(h, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """The field and the document score; made of arrays, so that it travels as bytes."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.code: dict[bytes, int] = {}
        self.values = np.zeros((1024, 3))

    @classmethod
    def fit(cls, texts: list[str], toxic: np.ndarray) -> Model:
        docs = [words_of(t) for t in texts]
        field = fit_field(docs, toxic)
        rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
        if field is None:
            return cls({"rate": np.array(min(rate, 0.29))})
        made = cls({**{k: np.asarray(v) for k, v in field.items()}, "logistic": np.zeros(4)})
        p, sizes = made.marginals(docs)
        made.arrays["logistic"] = fit_logistic(document_features(p, sizes), toxic.astype(float))
        return made

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **self.arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as f:
            return cls(dict(f))

    def _number(self, word: bytes) -> int:
        k = self.code[word] = len(self.code)
        if k >= len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        own, prev, nxt = buckets_of(word)
        w = self.arrays["weights"]
        self.values[k] = w[own].sum(), w[prev], w[nxt]
        return k

    def marginals(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens in a row, and the documents' numbers of tokens."""
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        if "weights" not in self.arrays or not sizes.sum():
            return np.zeros(int(sizes.sum())), sizes
        if len(self.code) > MEMO_WORDS:
            self.code.clear()
        get, number = self.code.get, self._number
        ids = []
        for d in docs:
            known = list(map(get, d))
            if None in known:
                known = [get(w, -1) if k is None else k for k, w in zip(known, d)]
                known = [number(w) if k < 0 and w not in self.code else self.code[w] if k < 0 else k for k, w in zip(known, d)]
            ids += known
        ids, first = np.array(ids), _firsts(sizes)
        a = self.arrays
        s = token_scores(ids, first, *self.values.T, float(a["bias"]))
        return forward_backward(s, first, a["trans"], a["start"])[0], sizes

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Document scores, and the spans of tokens that are likelier toxic than not."""
        docs = [words_of(t) for t in texts]
        p, sizes = self.marginals(docs)
        if "weights" not in self.arrays:
            return np.full(len(texts), float(self.arrays["rate"])), [[] for _ in texts]
        z = document_features(p, sizes) @ self.arrays["logistic"]
        spans: list[list[dict]] = [[] for _ in texts]
        begins = np.cumsum(sizes) - sizes
        bad = np.nonzero(p >= 0.5)[0]
        for i in np.unique(np.searchsorted(begins, bad, side="right") - 1):
            mine = {int(t - begins[i]) for t in bad if begins[i] <= t < begins[i] + sizes[i]}
            for k, m in enumerate(_WORD.finditer(texts[i])):
                if k in mine:
                    spans[i].append({"start": m.start(), "end": m.end(), "p": float(p[begins[i] + k])})
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled documents that are not held out. The sample goes by a hash of
    the id; a document of more than `chars` characters is left out of it."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    # A few times the bound, as some are missing among the documents or too long.
    wanted = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.filter(F.length("text") <= chars).join(F.broadcast(wanted), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable")
        order = np.argsort([zlib.crc32(str(i).encode()) for i in group["doc_id"]], kind="stable")
        group = group.iloc[order]
        model = Model.fit(group["text"].tolist(), group["toxic"].to_numpy() > 0)
        word_features.cache_clear()  # the worker goes on to other tasks
        return pd.DataFrame({"model": [model.to_bytes()]})

    made = found.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(fit, "model binary").first()
    return Model.from_bytes(bytes(made["model"])) if made else Model({"rate": np.array(0.0)})


class _Scorer:
    """A task's scoring; a worker keeps the last model and the words it has met."""

    last: tuple[str, Model] | None = None

    def __init__(self, sent, name: str):
        self.sent, self.name = sent, name

    def start(self):
        if _Scorer.last is None or _Scorer.last[0] != self.name:
            _Scorer.last = (self.name, Model.from_bytes(self.sent.value))
        model = _Scorer.last[1]

        def work(rows: dict) -> dict:
            score, spans = model.score(rows["text"])
            return {"doc_id": rows["doc_id"], "score": score, "spans": spans}

        return work


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, spans (start, end, p) of every row."""
    data = model.to_bytes()  # at most BUCKETS weights
    scorer = _Scorer(docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest())
    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scorer,
        "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>",
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    return score_documents(docs, train(docs, labels)).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "spans",
    )
