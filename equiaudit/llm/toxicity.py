"""Toxic spans by a linear-chain conditional random field (operator 9).

Labels are given per document, so tokens are labelled first: over a bounded
sample of labelled rows Spark counts, for every word and word beginning, the
toxic and the clean documents that have it; documents that have it in the same
context (word before, word after) count once, and so do copies.  Those found
in toxic documents far too often for chance form the lexicon; a token of a
toxic document is labelled 1 if it is in the lexicon.

The field has two states.  A token's features are its word and its beginnings
of four to eight characters; if one is in the lexicon, the shortest such
beginning alone, so that unseen forms of a known stem are found.
Weights are fitted on the labelled tokens by gradient ascent on the
conditional likelihood.

Scoring runs forward and backward over whole texts.  All texts of a batch form
one chain that is cut at document starts; products of transition matrices over
blocks make both passes vectorised and exact for texts of any length.  A
document's score is a logistic function of its largest marginal and of the sum
of its marginals, fitted on the labelled documents of the field; runs of tokens with a marginal
of ``SPAN`` or more are its offending spans (character offsets).

Defined cases: null and empty texts, and texts without a word, score 0 and
have no spans.  Without labelled rows of both kinds no lexicon exists, and
every text with words scores the share of toxic rows among the labelled ones.
Rows that repeat an id in the labels count each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import held_out, training_sample, written

TOKEN = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6, 7, 8)
#: Bounds of the fit: labelled rows for the lexicon (each kind), and for the field's weights.
SAMPLE_ROWS, FIT_ROWS = 4_000, 300
#: Features with a weight: entries of the lexicon, and the most common other words and beginnings.
MAX_LEXICON, MAX_COMMON = 10_000, 3_000
#: A lexicon entry needs this share of its documents toxic (kinds weighed equally), this many of them,
#: and a chance below exp(-SIGNIFICANCE) of that under no association.
PURITY, SUPPORT, SIGNIFICANCE = 0.85, 3, 14.0
SPAN = 0.5
PREDICT_AT = 0.7


def items_of(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings marked by an asterisk."""
    return [word, *[f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k]]


def features_of(word: str, lexicon: set[str] | frozenset[str]) -> list[str]:
    """The most general entry of the lexicon that the word has (its shortest beginning, or else itself), which then
    carries the whole weight for forms unseen in the sample; without one all its items."""
    items = items_of(word)
    return next(([x] for x in [*items[1:], word] if x in lexicon), items)


# ---- forward and backward over one chain of many documents


def steps(u: np.ndarray, starts: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(4, n): entries 00, 01, 10, 11 of each token's transition times emission.  Both rows of a matrix are alike where
    a document starts, which cuts the chain."""
    e = np.exp(np.clip(u, -30, 30))
    (m00, m01), (m10, m11) = np.exp(move)
    s0, s1 = np.exp(first)
    c = np.empty((4, len(u)))
    c[0], c[2] = m00, m10
    np.multiply(e, m01, out=c[1])
    np.multiply(e, m11, out=c[3])
    c[0, starts] = c[2, starts] = s0
    c[1, starts] = c[3, starts] = s1 * e[starts]
    return c


def chain_passes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward (states 0 and 1) and backward vectors of a chain of 2x2 matrices (4, n)."""
    n = c.shape[1]
    block = math.isqrt(n) + 1
    rows = -(-n // block)
    padded = np.empty((4, rows * block))
    padded[:, :n] = c
    padded[:, n:] = np.array([[1.0], [0.0], [0.0], [1.0]])
    # entry, place in the block, block: one place of all blocks lies together
    q = np.ascontiguousarray(padded.reshape(4, rows, block).transpose(0, 2, 1))
    a00, a01, a10, a11 = (x.copy() for x in q[:, 0])
    for j in range(1, block):
        m00, m01, m10, m11 = q[:, j]
        a00, a01, a10, a11 = (a00 * m00 + a01 * m10, a00 * m01 + a01 * m11, a10 * m00 + a11 * m10, a10 * m01 + a11 * m11)
        scale = 1 / (a00 + a01 + a10 + a11)
        a00, a01, a10, a11 = a00 * scale, a01 * scale, a10 * scale, a11 * scale
    whole = list(zip(a00.tolist(), a01.tolist(), a10.tolist(), a11.tolist(), strict=True))
    enter, x, y = [], 1.0, 0.0
    for m00, m01, m10, m11 in whole:
        enter.append((x, y))
        x, y = x * m00 + y * m10, x * m01 + y * m11
        x, y = x / (x + y), y / (x + y)
    leave, x, y = [], 0.5, 0.5
    for m00, m01, m10, m11 in reversed(whole):
        leave.append((x, y))
        x, y = m00 * x + m01 * y, m10 * x + m11 * y
        x, y = x / (x + y), y / (x + y)
    out = np.empty((4, block, rows))
    f0, f1 = np.array(enter).T
    for j in range(block):
        m00, m01, m10, m11 = q[:, j]
        f0, f1 = f0 * m00 + f1 * m10, f0 * m01 + f1 * m11
        scale = 1 / (f0 + f1)
        out[0, j], out[1, j] = f0, f1 = f0 * scale, f1 * scale
    b0, b1 = np.array(leave[::-1]).T
    for j in range(block - 1, -1, -1):
        out[2, j], out[3, j] = b0, b1
        m00, m01, m10, m11 = q[:, j]
        b0, b1 = m00 * b0 + m01 * b1, m10 * b0 + m11 * b1
        scale = 1 / (b0 + b1)
        b0, b1 = b0 * scale, b1 * scale
    return tuple(out.transpose(0, 2, 1).reshape(4, -1)[:, :n])


def _toxic_share(f0: np.ndarray, f1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    one = f1 * b1
    return one / (f0 * b0 + one)


def marginals(u: np.ndarray, starts: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(toxic) of every token, given emissions ``u`` (toxic against clean) and the positions of document starts."""
    return _toxic_share(*chain_passes(steps(u, starts, first, move))) if len(u) else np.empty(0)


def document_features(p: np.ndarray) -> np.ndarray:
    """Of a document's marginals: 1, the log odds of the largest, the log of 1 + the sum of those that count."""
    top = min(max(float(p.max()), 1e-9), 1 - 1e-9)
    return np.array([1.0, math.log(top / (1 - top)) / 5, math.log1p(float(p[p >= 0.05].sum()))])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.005) -> np.ndarray:
    """Newton's method; the penalty holds the weights down where the kinds are apart."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(curve, grad)
        w = w + move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
    return w


# ---- the model


@dataclass
class SpanModel:
    weights: dict[str, float] = field(default_factory=dict)
    lexicon: frozenset[str] = frozenset()
    bias: float = 0.0
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Of the logistic score: constant, largest marginal, sum of marginals.
    document: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Score of every text with words, if nothing could be learned.
    constant: float | None = None

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(x, 0.0) for x in features_of(word, self.lexicon))


class _Emissions(dict):
    def __init__(self, model: SpanModel, most: int = 500_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = u = self.model.emission(word)
        return u


def fit_field(feature: np.ndarray, per_token: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_features: int,
              rounds: int = 80, rate: float = 0.3, penalty: float = 0.05
              ) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, start and transition scores that maximise the penalised conditional likelihood (Adam).

    ``feature``: the feature numbers of all tokens in order, ``per_token`` of each; ``lengths``: tokens of each
    document (none empty); ``labels``: 0 or 1 per token."""
    starts = np.cumsum(lengths) - lengths
    y = labels.astype(np.float64)
    token = np.repeat(np.arange(len(y), dtype=np.int32), per_token)
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    t = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[t - 1].astype(int), y[t].astype(int)), 1)
    began = np.array([(y[starts] == 0).sum(), (y[starts] == 1).sum()], dtype=np.float64)

    # one vector: weights, bias, start scores, transitions
    x = np.zeros(n_features + 1 + 2 + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        w, bias, first, move = x[:n_features], x[n_features], x[n_features + 1:n_features + 3], x[-4:].reshape(2, 2)
        u = bias + np.bincount(token, w[feature], len(y))
        c = steps(u, starts, first, move)
        f0, f1, b0, b1 = chain_passes(c)
        p = _toxic_share(f0, f1, b0, b1)
        pair = np.stack([f0[t - 1] * c[0, t] * b0[t], f0[t - 1] * c[1, t] * b1[t],
                         f1[t - 1] * c[2, t] * b0[t], f1[t - 1] * c[3, t] * b1[t]])
        pair /= pair.sum(axis=0)
        miss = y - p
        grad = np.concatenate([
            np.bincount(feature, miss[token], n_features) - penalty * w, [miss.sum()],
            began - np.array([(1 - p[starts]).sum(), p[starts].sum()]), seen.ravel() - pair.sum(axis=1)])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        x = x + rate / math.sqrt(1 + k / 20) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return x[:n_features], float(x[n_features]), x[n_features + 1:n_features + 3], x[-4:].reshape(2, 2)


def item_counts(rows: DataFrame) -> DataFrame:
    """(text, toxic) -> (item, c1, c0): toxic and clean documents with the item.  Documents that have it in the same
    context (the words before and after, the least by code points of a document) count once, so copies do too."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                items, around, kinds = [], [], []
                for text, toxic in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True):
                    words = TOKEN.findall(text.lower())
                    found: dict[str, str] = {}
                    for word, before, after in zip(words, ["", *words], [*words[1:], ""], strict=False):
                        own = f"{before} {after}"
                        for x in items_of(word):
                            if (least := found.get(x)) is None or own < least:
                                found[x] = own
                    items += found
                    around += found.values()
                    kinds += [toxic] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.string()), pa.array(around, pa.string()), pa.array(kinds, pa.int32())],
                    names=["item", "around", "toxic"])

    seen = rows.select("text", "toxic").mapInArrow(contexts, "item string, around string, toxic int")
    own = seen.select("item", "toxic", F.xxhash64("around").alias("around")).distinct()
    return own.groupBy("item").agg(F.count_if(F.col("toxic") == 1).alias("c1"),
                                   F.count_if(F.col("toxic") == 0).alias("c0"))


def train_spans(rows: DataFrame, id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, fit_rows: int = FIT_ROWS,
                max_lexicon: int = MAX_LEXICON, max_common: int = MAX_COMMON) -> SpanModel:
    """Learn from (id, text, toxic 0/1); nulls are left out."""
    usable = rows.where(F.col("text").isNotNull() & F.col("toxic").isNotNull())
    have = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = have.get(1, 0) / max(1, sum(have.values()))
    if not have.get(1) or not have.get(0):
        return SpanModel(constant=share)
    kinds = [training_sample(usable.where(F.col("toxic") == k), id_col, sample_rows, total=have[k]) for k in (1, 0)]
    sample = written(kinds[0].unionByName(kinds[1]).select(
        F.col(id_col).alias("id"), "text", F.col("toxic").cast("int").alias("toxic")), "toxic-sample")

    items = written(item_counts(sample), "toxic-items")
    t1, t0 = items.agg(F.sum("c1"), F.sum("c0")).first()
    if not t1 or not t0:
        return SpanModel(constant=share)
    items = items.where(F.col("c1") + F.col("c0") >= SUPPORT)
    p = t1 / (t1 + t0)
    # Chernoff's bound on the chance of c1 or more toxic documents among c1 + c0
    n, q = F.col("c1") + F.col("c0"), F.col("c1") / (F.col("c1") + F.col("c0"))
    excess = n * (q * F.log(q / F.lit(p)) + F.coalesce((1 - q) * F.log((1 - q) / F.lit(1 - p)), F.lit(0.0)))
    pure = F.col("c1") / t1 / (F.col("c1") / t1 + F.col("c0") / t0)
    is_toxic = (F.col("c1") >= SUPPORT) & (pure >= PURITY) & (q > p) & (excess >= SIGNIFICANCE)
    rated = items.withColumn("lexicon", is_toxic)
    lexicon = {r["item"] for r in rated.where("lexicon").orderBy(F.desc("c1"), "item").limit(max_lexicon).collect()}
    common = [r["item"] for r in rated.where("not lexicon").orderBy(F.desc(n), "item").limit(max_common).collect()]
    if not lexicon:
        return SpanModel(constant=share)
    number = {x: i for i, x in enumerate([*sorted(lexicon), *common])}

    fit = training_sample(sample.where("toxic = 1"), "id", fit_rows, "fit").unionByName(
        training_sample(sample.where("toxic = 0"), "id", fit_rows, "fit")).select("text", "toxic").collect()
    feature, per_token, lengths, labels, kinds = [], [], [], [], []
    for r in fit:
        if not (words := TOKEN.findall(r["text"].lower())):
            continue
        own = {w: [x for x in features_of(w, lexicon) if x in number] for w in set(words)}
        bad = {w for w, xs in own.items() if r["toxic"] == 1 and not lexicon.isdisjoint(xs)}
        feature.append(np.array([number[x] for w in words for x in own[w]], dtype=np.int32))
        per_token.append(np.array([len(own[w]) for w in words], dtype=np.int16))
        labels.append(np.array([w in bad for w in words], dtype=np.int8))
        lengths.append(len(words))
        kinds.append(r["toxic"])
    if not any(x.any() for x in labels):
        return SpanModel(constant=share)
    del fit
    feature, per_token = np.concatenate(feature), np.concatenate(per_token)
    w, bias, first, move = fit_field(feature, per_token, np.array(lengths), np.concatenate(labels), len(number))
    token = np.repeat(np.arange(len(per_token), dtype=np.int32), per_token)
    u = bias + np.bincount(token, w[feature], len(per_token))
    ends = np.cumsum(lengths)
    p = marginals(u, ends - lengths, first, move)
    x = np.array([document_features(p[e - n:e]) for n, e in zip(lengths, ends, strict=True)])
    y = np.array(kinds, dtype=np.float64)
    weight = np.where(y == 1, share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum())) * len(y)
    return SpanModel({x: float(w[i]) for x, i in number.items() if w[i]}, frozenset(lexicon), bias, first, move,
                     fit_logistic(x, y, weight))


def toxic_spans(docs: DataFrame, model: SpanModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): spans as arrays of (start, end) in characters, the end not included."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_lexicon + max_common weights
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Emissions(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                tokens = [TOKEN.findall(x.lower()) for x in texts]
                n = np.array([len(x) for x in tokens])
                if model.constant is not None:
                    scores, spans = [model.constant if x else 0.0 for x in tokens], [[] for _ in tokens]
                else:
                    u = np.fromiter((known[w] for t in tokens for w in t), np.float64, int(n.sum()))
                    starts = np.cumsum(n) - n
                    p = marginals(u, starts[n > 0], model.first, model.move)
                    scores, spans = [], []
                    for x, a, k in zip(texts, starts.tolist(), n.tolist(), strict=True):
                        own = p[a:a + k]
                        z = float(document_features(own) @ model.document) if k else -math.inf
                        scores.append(1 / (1 + math.exp(-max(z, -700.0))) if k else 0.0)
                        spans.append(_spans(x, own) if k and own.max() >= SPAN else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)],
                    names=["doc_id", "score", "spans"])

    return rows.mapInArrow(score, f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    lowered = text.lower()
    same = len(lowered) == len(text)  # else offsets count in the lower-cased text
    last = -2
    for i, m in enumerate(TOKEN.finditer(lowered if not same else text)):
        if i < len(p) and p[i] >= SPAN:
            if i == last + 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = i
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans); learned from the labelled rows that are not held out."""
    told = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("toxic"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = own.join(told, F.col("doc_id") == F.col("l_id")).where(~held_out("doc_id", 3, 1))
    model = train_spans(rows.select("doc_id", "text", "toxic"), "doc_id", **bounds)
    scored = toxic_spans(own, model, "doc_id", "text")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"), "spans")
