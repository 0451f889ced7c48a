"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are runs of letters or digits; a token is toxic or not. Its features are the lower-cased word, its
beginnings and endings and its n-grams, each known by a 64-bit hash and with a weight of its own if
training met it; neighbours are tied by learned transitions. Forward-backward runs over whole texts as a scan of 2 x 2 matrices, many texts end to end in
one stream: a text's first matrix has equal rows, so nothing passes from one text to the next, and the
cost of a token does not depend on the length of its text.

Training tokens. Documents carry the labels, so tokens get theirs from them: a stem (a word or a beginning
of one) that labelled toxic texts hold far more often than clean ones, and that is met first after many
different words (so copies of one text do not count as many), marks its tokens in toxic texts. The field is trained on these and then marks the toxic texts anew for a second
round, which finds inflections that no stem covers. Clean texts hold no toxic token.

Learned: labelled texts whose crc32(doc_id) mod 5 is not 0, at most ``SAMPLE`` different ones of each
class by hash of the text, whole. Four of five parts of them train a field each, in a task each, and their
weights are averaged; the last part fits the score: a logistic regression on the largest marginal and on the
number and share of toxic tokens by their marginals.

Defined results: a null or empty text has no token and the score of a text without any (its features are 0);
labels that are null or not 0 or 1 are ignored; several labels of an id count as their majority, and as none
if even; without labels of both classes every score is 0 and no span is found. Repeated rows are scored
alike, ties cannot arise, columns other than the id and the text are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesight.llm.common import remainder
from sitesight.workspace import keep

#: Labelled texts of each class, parts they are dealt to, and texts' tokens that a task holds at once.
SAMPLE, PARTS, TOKENS = 2000, 5, 500_000
STEPS, SMALL, CUT = (20, 10), 1e-3, 0.5
#: A stem marks tokens if its rate in toxic texts over that in clean ones and the number of different words before its first place in a text (of 63 classes) reach these.
ODDS, CONTEXTS, STEM = 8.0, 8, (4, 8)
_TOKENS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed feature, value) of every feature of every word, from rolling hashes of all words end to end."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(len(codes) + 1, _BASE))
    back = np.cumprod(np.full(len(codes) + 1, _INVERSE))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power[:-1])])
    first = np.cumsum(length) - length
    last = first + length
    of = np.repeat(np.arange(len(words)), length)
    rows, hashes, values = [], [], []

    def add(kind: int, row: np.ndarray, low: np.ndarray, high: np.ndarray, value) -> None:
        h = ((upto[high] - upto[low]) * back[low] + np.uint64(kind)) * _BASE
        h = (h ^ (h >> np.uint64(29))) * _BASE
        rows.append(row)
        hashes.append(h ^ (h >> np.uint64(32)))
        values.append(np.broadcast_to(np.float64(value) if np.isscalar(value) else value, row.shape))

    every = np.arange(len(words))
    add(1, every, first, last, 1.0)
    for q in range(2, 9):
        at = np.flatnonzero(length > q)
        add(10 + q, at, first[at], first[at] + q, 1.0)
    for q in range(2, 6):
        at = np.flatnonzero(length > q)
        add(20 + q, at, last[at] - q, last[at], 1.0)
    for q in (3, 4):
        at = np.flatnonzero(np.arange(len(codes)) + q <= last[of])
        add(30 + q, of[at], at, at + q, 2.0 / length[of[at]])
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(values)


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, start: tuple[float, float], width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The row vector ``start`` times the first t matrices [[a, b], [c, d]], for every t, scaled to a sum of 1.

    Matrices are dealt to rows of ``width``; all rows are multiplied up at once, the rows' whole products are
    scanned the same way, and what enters a row is applied to it.
    """
    n, rows = len(a), -(-len(a) // width)
    grid = [np.concatenate([x, np.full(rows * width - n, fill)]).reshape(rows, width).T.copy() for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    ga, gb, gc, gd = grid
    for t in range(1, width):
        pa_, pb, pc, pd_ = ga[t - 1], gb[t - 1], gc[t - 1], gd[t - 1]
        na, nb, nc, nd = pa_ * ga[t] + pb * gc[t], pa_ * gb[t] + pb * gd[t], pc * ga[t] + pd_ * gc[t], pc * gb[t] + pd_ * gd[t]
        scale = 1.0 / (na + nb + nc + nd)
        ga[t], gb[t], gc[t], gd[t] = na * scale, nb * scale, nc * scale, nd * scale
    into0, into1 = np.full(rows, start[0]), np.full(rows, start[1])
    if rows > 1:
        into0[1:], into1[1:] = _scan(ga[-1, :-1], gb[-1, :-1], gc[-1, :-1], gd[-1, :-1], start, width)
    out0, out1 = into0 * ga + into1 * gc, into0 * gb + into1 * gd
    total = out0 + out1
    return (out0 / total).T.ravel()[:n], (out1 / total).T.ravel()[:n]


def marginals(unary: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token of texts laid end to end, and the expected moves between their neighbours.

    ``unary`` is the log-odds of toxic by the token alone, ``first`` whether a token begins a text.
    """
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    hot = 1.0 / (1.0 + np.exp(-np.clip(unary, -40, 40)))
    w = np.exp(move - move.max())
    a, b, c, d = (np.where(first, x, x * m) for x, m in ((1 - hot, w[0, 0]), (hot, w[0, 1]), (1 - hot, w[1, 0]), (hot, w[1, 1])))
    from0, from1 = _scan(a, b, c, d, (0.5, 0.5))
    to0, to1 = np.ones(n), np.ones(n)
    if n > 1:
        back = _scan(a[:0:-1], c[:0:-1], b[:0:-1], d[:0:-1], (0.5, 0.5))
        to0[:-1], to1[:-1] = back[0][::-1], back[1][::-1]
    p = from1 * to1 / (from0 * to0 + from1 * to1)
    inner = np.flatnonzero(~first[1:]) + 1
    f0, f1, t0, t1 = from0[inner - 1], from1[inner - 1], to0[inner], to1[inner]
    pair = np.stack([f0 * a[inner] * t0, f0 * b[inner] * t1, f1 * c[inner] * t0, f1 * d[inner] * t1])
    return p, (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)


class Stream:
    """Texts' tokens end to end: their distinct words, each token's word, and where texts begin."""

    def __init__(self, texts: list[list[str]]):
        place: dict[str, int] = {}
        self.word = np.array([place.setdefault(w, len(place)) for x in texts for w in x], np.int64)
        self.words = list(place)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.zeros(len(self.word), bool)
        self.first[(np.cumsum(self.length) - self.length)[self.length > 0]] = True


@dataclass
class Field:
    """Known features (sorted hashes) and their weights, transitions, and the log-odds of a token without features."""

    keys: np.ndarray
    weight: np.ndarray
    move: np.ndarray
    bias: float

    def unary(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        row, hashed, value = features(words)
        at = np.searchsorted(self.keys, hashed)
        known = np.flatnonzero(at < len(self.keys))
        known = known[self.keys[at[known]] == hashed[known]]
        return self.bias + np.bincount(row[known], self.weight[at[known]] * value[known], len(words))


def fresh() -> Field:
    return Field(np.zeros(0, np.uint64), np.zeros(0), np.zeros((2, 2)), -3.0)


def train(stream: Stream, gold: np.ndarray, again, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Gradient ascent on the penalised log-likelihood, each weight's step falling as it moves.

    ``again`` gives the labels of the second round from the first's labels and marginals.
    """
    if not stream.words:
        return fresh()
    row, hashed, value = features(stream.words)
    keys, place = np.unique(hashed, return_inverse=True)
    weight, move, bias = np.zeros(len(keys)), np.zeros((2, 2)), -3.0
    used, used_move, used_bias = np.full(len(keys), 1e-2), np.ones((2, 2)), 1.0
    inner = np.flatnonzero(~stream.first[1:]) + 1
    p = np.zeros(0)
    for k, steps in enumerate(STEPS):
        if k:
            gold = again(gold, p)
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
        for _ in range(steps):
            alone = bias + np.bincount(row, weight[place] * value, len(stream.words))
            p, pairs = marginals(alone[stream.word], move, stream.first)
            miss = np.bincount(stream.word, gold - p, len(stream.words))
            grad = np.bincount(place, miss[row] * value, len(keys)) - decay * weight
            grad_move, grad_bias = seen - pairs - decay * move, miss.sum()
            used, used_move, used_bias = used + grad**2, used_move + grad_move**2, used_bias + grad_bias**2
            weight = weight + rate * grad / np.sqrt(used)
            move = move + rate * grad_move / np.sqrt(used_move)
            bias = float(bias + rate * grad_bias / np.sqrt(used_bias))
    large = np.abs(weight) >= SMALL
    return Field(keys[large], weight[large], move, bias)


def tokens(text: str | None) -> list[str]:
    return [w.lower() for w in _TOKENS.findall(text or "")]


def stems_of(word: str) -> list[str]:
    return [f"{word}$"] + [word[:q] for q in range(STEM[0], min(STEM[1], len(word) - 1) + 1)]


def marking_stems(sample: DataFrame) -> DataFrame:
    """(stem) that marks tokens: words (ending in ``$``) and beginnings typical of toxic texts, in many contexts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                seen: dict[str, int] = {}
                before = ""
                for w in tokens(text):
                    bit = 1 << (zlib.crc32(before.encode("utf-8", "surrogatepass")) % 63)
                    for s in stems_of(w):
                        seen.setdefault(s, bit)
                    before = w
                for s, mask in seen.items():
                    row = found.setdefault(s, [0, 0, 0])
                    row[toxic] += 1
                    if toxic:
                        row[2] |= mask
            yield pd.DataFrame([(s, *r) for s, r in found.items()], columns=["stem", "clean", "toxic", "mask"])

    counts = sample.select("text", "toxic").mapInPandas(count, "stem string, clean long, toxic long, mask long")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = counts.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_or("mask").alias("mask"))
    # three clean texts more than were met: no rarer rate can be told from so many texts
    odds = F.col("toxic") / F.lit(float(max(1, n.get(1, 0)))) / ((F.col("clean") + 3) / F.lit(float(max(1, n.get(0, 0)))))
    return total.where((odds >= ODDS) & (F.bit_count("mask") >= CONTEXTS)).select("stem")


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic, part): different labelled texts, at most ``size`` of each class, thinned before they are ranked."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("y"))
    one = one.where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("toxic"))
    text = F.col("text").cast("string")
    hashed = docs.where(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"))
    known = keep(hashed.join(one, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")), "known")
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    u = F.col("h") / F.lit(2.0**64) + 0.5
    share = F.when(F.col("toxic") == 1, min(1.0, (2.0 * size + 100) / max(1, n.get(1, 0)))).otherwise(min(1.0, (2.0 * size + 100) / max(1, n.get(0, 0))))
    first = Window.partitionBy("toxic").orderBy("h", "doc_id")
    picked = known.where(u <= share).withColumn("r", F.row_number().over(first)).where(F.col("r") <= size)
    # at most 2 * size rows: a bound by parameter
    chosen = F.broadcast(picked.select(F.col("doc_id").alias("id"), F.col("h").alias("of"), "toxic", (F.col("r") % PARTS).cast("int").alias("part")))
    source = docs.where(text.isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return source.join(chosen, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("of"))).dropDuplicates(["doc_id"]).select("text", "toxic", "part")


def _train_part(stems: set[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["text", "toxic"])
        stream = Stream([tokens(t) for t in pdf["text"]])
        toxic = np.repeat(pdf["toxic"].to_numpy(), stream.length)
        marked = np.array([any(s in stems for s in stems_of(w)) for w in stream.words], bool)
        gold = (marked[stream.word] & (toxic == 1)).astype(np.int64) if len(stream.words) else np.zeros(0, np.int64)
        field = train(stream, gold, lambda gold, p: (((p >= CUT) | (gold == 1)) & (toxic == 1)).astype(np.int64))
        return pd.DataFrame({"n": [len(pdf)], "keys": [field.keys.tobytes()], "weight": [field.weight.tobytes()], "move": [field.move.tobytes()], "bias": [field.bias]})

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Field, list[float]] | None:
    """A field and the weights of its document score; None without texts of both classes."""
    known = keep(_sample(docs, labels, sample), "toxic_sample")
    if known.select("toxic").distinct().count() < 2:
        return None
    stems = {r["stem"] for r in marking_stems(known).collect()}
    trained = known.where(F.col("part") > 0).groupBy("part").applyInPandas(_train_part(stems), "n long, keys binary, weight binary, move binary, bias double").collect()
    share = np.array([r["n"] for r in trained]) / sum(r["n"] for r in trained)
    keys, place = np.unique(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in trained]), return_inverse=True)
    weight = np.bincount(place, np.concatenate([q * np.frombuffer(r["weight"]) for q, r in zip(share, trained)]), len(keys))
    move = sum(q * np.frombuffer(r["move"]).reshape(2, 2) for q, r in zip(share, trained))
    field = Field(keys, weight, move, float(sum(q * r["bias"] for q, r in zip(share, trained))))
    held = known.where("part = 0")
    if held.select("toxic").distinct().count() < 2:
        held = known
    judged = keep(tagged(held.withColumn("doc_id", F.col("toxic")), field).select(F.col("doc_id").cast("double").alias("label"), array_to_vector("x").alias("features")), "judged")
    model = LogisticRegression(regParam=1e-3, standardization=False, maxIter=100).fit(judged)
    return field, [float(model.intercept), *map(float, model.coefficients)]


def tagged(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, n_tokens, x, spans) of each row of ``docs`` (doc_id, text).

    ``spans`` are runs of tokens whose marginal is at least one half: start, end (code points, end exclusive)
    and the mean marginal. ``x`` are the measures of the score: the largest marginal, the logarithm of one more
    than the sum of squared marginals (so that many tokens of a small marginal do not add up), and that sum's
    share of the tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("x", pa.list_(pa.float64())), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        known: dict[str, float] = {}

        def judged(ids: list, texts: list[str], words: list[list[str]]) -> pa.RecordBatch:
            nonlocal known
            if len(known) > 300_000:
                known = {}
            new = list({w for x in words for w in x}.difference(known))
            known.update(zip(new, field.unary([w.lower() for w in new]).tolist()))
            length = np.fromiter(map(len, words), np.int64, len(words))
            unary = np.fromiter((known[w] for x in words for w in x), np.float64, length.sum())
            low = np.cumsum(length) - length
            first = np.zeros(len(unary), bool)
            first[low[length > 0]] = True
            p, _ = marginals(unary, field.move, first)
            full = np.flatnonzero(length)
            x = np.zeros((len(words), 3))
            if len(full):
                total = np.add.reduceat(p * p, low[full])
                x[full] = np.stack([np.maximum.reduceat(p, low[full]), np.log1p(total), total / length[full]], axis=1)
            spans: list[list] = [[] for _ in words]
            for d in np.flatnonzero(x[:, 0] >= CUT):
                mine = p[low[d]: low[d] + length[d]]
                hot = np.flatnonzero(mine >= CUT)
                at = [m.span() for m in _TOKENS.finditer(texts[d])]
                for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
                    spans[d].append({"start": at[run[0]][0], "end": at[run[-1]][1], "p": float(min(1.0, mine[run].mean()))})
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(length), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(spans, pa.list_(span))], schema=schema)

        for batch in batches:
            ids, texts, words, held = [], [], [], 0
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py() or "")
                words.append(_TOKENS.findall(texts[-1]))
                held += len(words[-1])
                if held >= TOKENS or i == batch.num_rows - 1:
                    yield judged(ids, texts, words)
                    ids, texts, words, held = [], [], [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, x array<double>, spans array<struct<start: long, end: long, p: double>>")


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, spans) of each row of ``docs``."""
    held_out = remainder("doc_id", 5) == 0
    model = fit(docs.where(~held_out), labels, sample)
    if model is None:
        found, score = tagged(docs, fresh()).withColumn("spans", F.slice("spans", 1, 0)), F.lit(0.0)
    else:
        field, (bias, *weights) = model
        found = tagged(docs, field)
        score = 1 / (1 + F.exp(-sum((F.element_at("x", k + 1) * F.lit(w) for k, w in enumerate(weights)), F.lit(bias))))
    found = found.select("doc_id", held_out.alias("held_out"), score.alias("score"), "n_tokens", "spans")
    return found.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
