"""Document probability under a unigram piece model, over all segmentations.

The pieces and their ranks come from an existing vocabulary file. Their probabilities are those
of the pieces in the training words as the vocabulary's own tokenizer cuts them, smoothed by the
file's scores (a score of -r counts as 1/(r + 2.7)). A word's probability is the sum over every
way to cut it into pieces, by a forward recursion in log space; characters outside the
vocabulary fall back to bytes. A text's is the product over its words and one end.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Spark counts all training words. The most
frequent ones, up to ``HOT`` of them, go to every task; the others, of which none is frequent,
meet their counts in a join. Learned: rows whose crc32(doc_id) mod 7 is not 2.

A null text is empty: it has one token, the end. Rows are kept apart even if they repeat. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.llm.common import per_batch, remainder
from sitesight.workspace import keep

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HOT, FLUSH = 200_000, 400_000
SMOOTHING = 1000.0
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = "▁"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "ignore").lower().split()


class Lattice:
    """Log probabilities of words under piece log probabilities ``logp`` (by piece id)."""

    def __init__(self, pieces: list[str], kinds: list[str], logp: np.ndarray):
        normal = [i for i, k in enumerate(kinds) if k == "normal"]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                powers.append(powers[-1] * _STEP)
            keys = np.array([self._hash(pieces[i]) for i in normal], np.uint64)
        self.power = np.array(powers, np.uint64)
        order = np.argsort(keys)
        self.key, self.value = keys[order], logp[np.array(normal)][order]
        self.byte = {int(pieces[i][3:5], 16): logp[i] for i, k in enumerate(kinds) if k == "byte"}
        self.floor = float(logp.min())

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    def _bytes(self, char: int) -> float:
        return sum(self.byte.get(b, self.floor) for b in chr(char).encode("utf-8", "replace"))

    def log_prob(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, words of one length at a time."""
        texts = [_SPACE + w.decode("utf-8", "replace") for w in words]
        length = np.array([len(t) for t in texts])
        out = np.zeros(len(texts))
        for m in np.unique(length):
            at = np.flatnonzero(length == m)
            for low in range(0, len(at), 8192):
                some = at[low: low + 8192]
                code = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), m)
                out[some] = self._forward(code)
        return out

    def _forward(self, code: np.ndarray) -> np.ndarray:
        n, m = code.shape
        head = np.zeros((m + 1, n), np.uint64)
        alpha = np.full((m + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, m + 1):
            head[j] = head[j - 1] * _STEP + (code[:, j - 1].astype(np.uint64) + np.uint64(1))
            low = max(0, j - self.longest)
            part = head[j] - head[low:j] * self.power[j - low:0:-1, None]
            at = np.minimum(np.searchsorted(self.key, part), len(self.key) - 1)
            step = np.where(self.key[at] == part, self.value[at], -np.inf)
            lone = np.flatnonzero(np.isinf(step[-1]))
            if len(lone):
                chars, back = np.unique(code[lone, j - 1], return_inverse=True)
                step[-1, lone] = np.array([self._bytes(int(c)) for c in chars])[back]
            paths = alpha[low:j] + step
            best = paths.max(axis=0)
            alpha[j] = best + np.log(np.exp(paths - best).sum(axis=0))
        return alpha[m]


def vocabulary(path: str) -> tuple[bytes, list[str], list[str], np.ndarray]:
    """The model file, its pieces, their kinds and the probabilities that their scores stand for."""
    with open(path, "rb") as f:
        raw = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    ids = range(sp.get_piece_size())
    kind = ["control" if sp.is_control(i) or sp.is_unknown(i) else "byte" if sp.is_byte(i) else "normal" for i in ids]
    prior = np.array([0.0 if k == "control" else 1e-6 if k == "byte" else 1 / (abs(sp.get_score(i)) + 2.7) for i, k in zip(ids, kind)])
    return raw, [sp.id_to_piece(i) for i in ids], kind, prior / prior.sum()


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): every word of ``docs`` (doc_id, text) with its count, summed in the tasks first."""
    schema = pa.schema([("w", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)
            counts.clear()
            return done

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, model: Broadcast) -> DataFrame:
    """(piece, n): how often each piece occurs in the counted words, as the vocabulary's tokenizer cuts them."""
    schema = pa.schema([("piece", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            cut = sp.encode([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], num_threads=1)
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            flat = np.fromiter((i for x in cut for i in x), np.int64, size.sum())
            np.add.at(total, flat, np.repeat(batch.column(1).to_numpy(), size))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], schema=schema)

    return counts.select("w", "c").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n"))


_held: dict[int, tuple] = {}


def _tools(model: Broadcast) -> tuple:
    """Once in each Python worker: the lattice, and (log10(c + 1), log p) of each hot word."""
    if id(model.value) not in _held:
        pieces, kinds, logp, hot, counts = model.value
        lattice = Lattice(pieces, kinds, logp)
        scores = lattice.log_prob(hot).tolist()
        _held.clear()
        _held[id(model.value)] = lattice, {w: (math.log10(c + 1), s) for w, c, s in zip(hot, counts, scores)}, model.value
    return _held[id(model.value)][:2]


def scored(docs: DataFrame, path: str = VOCABULARY, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``."""
    spark = docs.sparkSession
    held = remainder("doc_id", 7) == 2
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held_out"))
    counts = keep(word_counts(source.where("not held_out")), "words")
    ends = source.where("not held_out").count()
    tokens, kinds_seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = tokens + ends, kinds_seen + (ends > 0)

    raw, pieces, kinds, prior = vocabulary(path)
    seen = np.zeros(len(pieces))
    for piece, c in piece_counts(counts, spark.sparkContext.broadcast(raw)).collect():
        seen[piece] = c
    seen[[k == "control" for k in kinds]] = 0
    whole = seen.sum() + SMOOTHING + ends + 1
    with np.errstate(divide="ignore"):
        logp = np.log((seen + SMOOTHING * prior) / whole)
    logp[~np.isfinite(logp)] = math.log(1e-9)
    end = math.log((ends + 1) / whole)
    top = counts.orderBy(F.desc("c"), "w").limit(hot).collect()
    model = spark.sparkContext.broadcast((pieces, kinds, logp, [bytes(r[0]) for r in top], [r[1] for r in top]))

    base_end = math.log10(ends + 1) if ends else 0.0
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("gain", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, known = _tools(model)
        cache: dict[bytes, float] = {}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                docs_words = [Counter(words_of(t)) for t in part.column(1).to_pylist()]
                if len(cache) > FLUSH:
                    cache.clear()
                new = list({w for x in docs_words for w in x if w not in known and w not in cache})
                cache.update(zip(new, lattice.log_prob(new).tolist()))
                out: dict[str, list] = {k: [] for k in ("row", "n_tokens", "n_known", "gain", "score", "rare", "times")}
                for x in docs_words:
                    n_known, gain, score = (1, base_end, end) if ends else (0, 0.0, end)
                    rare, times = [], []
                    for w, c in x.items():
                        hit = known.get(w)
                        if hit:
                            n_known += c
                            gain += c * hit[0]
                            score += c * hit[1]
                        else:
                            score += c * cache[w]
                            rare.append(w)
                            times.append(c)
                    for k, y in zip(out, (row, x.total() + 1, n_known, gain, score / math.log(10), rare, times)):
                        out[k].append(y)
                    row += 1
                columns = out | {"doc_id": part.column(0), "held_out": part.column(2)}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, gain double, score double, rare array<binary>, times array<int>"
    rows = keep(source.mapInArrow(run, ddl), "texts")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("w"), F.col("x.times").alias("t"))
    more = rare.join(counts, "w").groupBy("row").agg(F.sum("t").alias("k"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("g"))
    out = rows.drop("rare", "times").join(more, "row", "left")
    base = F.col("gain") + F.coalesce("g", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + v + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
