"""Language of words and documents by a linear-chain conditional random field.

A word (a run of letters, lower-cased) has affix, n-gram and lexicon features with a weight for
each language; neighbouring words are tied by learned transitions. Training sequences are runs
of words from labelled texts, in part joined across languages, so the transitions learn both to
stay and to switch in code-switched text. Forward-backward over the whole text gives each word
its language probabilities; a document's are their mean, and ``segments`` its words' languages.

Learned: texts with a ``lang`` whose crc32(doc_id) mod 4 is not 2, at most ``SAMPLE`` of each language by
hash of the row, each text whole, cut into runs of ``RUN_WORDS`` words. Parts of the sample are trained in
separate tasks and their weights averaged.

Texts that are null or have no letter are ``und`` with score 0 and no segments, as are all if nothing is
labelled; an empty table gives an empty one. Of equally likely languages the first by name wins. Long
texts are scored whole. Repeated rows are scored alike. Only the text decides; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesight.llm.common import remainder, small
from sitesight.workspace import keep

SAMPLE, RUN_WORDS, PARTS = 300, 24, 4
BITS, LEXICON, EPOCHS = 16, 300, 4
TOKENS = 1_000_000
_WORDS = re.compile(r"[^\W\d_]+").findall
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters; a digit such as a raised 2 or a fraction ends a run."""
    words = _WORDS((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words for x in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else [w])]


def _features(words: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, float]]]]:
    """For words of one length at a time: their places, and (hashed feature, value) columns."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for m in np.unique(length):
        at = np.flatnonzero(length == m)
        code = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), m).astype(np.uint64)
        columns: list[tuple[np.ndarray, float]] = []

        def add(kind: int, low: int, high: int, value: float, code=code, columns=columns) -> None:
            h = np.full(len(code), kind, np.uint64)
            for k in range(low, high):
                h = (h ^ code[:, k]) * _STEP
                h ^= h >> np.uint64(31)
            columns.append(((h * _STEP >> np.uint64(64 - BITS)).astype(np.int64), value))

        for k in range(1, min(3, m) + 1):
            add(k, 0, k, 1.0)
        for k in range(1, min(4, m) + 1):
            add(8 + k, m - k, m, 1.0)
        grams = max(1, 2 * m - 3)
        for k in range(m - 1):
            add(16, k, k + 2, 3.0 / grams)
        for k in range(m - 2):
            add(17, k, k + 3, 3.0 / grams)
        if m <= 32:
            add(24, 0, m, 1.0)
        yield at, columns


class Field:
    """Weights (features, languages), lexicon (word -> languages it is common in) and transitions."""

    def __init__(self, langs: list[str], lexicon: dict[str, list[int]]):
        self.langs, self.lexicon = langs, lexicon
        self.weight = np.zeros((1 << BITS, len(langs)), np.float32)
        self.common = np.zeros((len(langs), len(langs)), np.float32)
        self.move = np.zeros((len(langs), len(langs)), np.float32)

    def _known(self, words: list[str]) -> np.ndarray:
        known = np.zeros((len(words), len(self.langs)), np.float32)
        for i, w in enumerate(words):
            for k in self.lexicon.get(w, ()):
                known[i, k] = 1
        return known

    def emissions(self, words: list[str], features: list | None = None) -> np.ndarray:
        out = self._known(words) @ self.common
        for at, columns in features or _features(words):
            out[at] += sum(self.weight[h] * np.float32(v) for h, v in columns)
        return out

    def marginals(self, emission: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word marginals, and sums of pair marginals, of sequences laid end to end."""
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length))
        active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        base = np.concatenate([[0], np.cumsum(active)])
        step = np.arange(len(emission)) - np.repeat(np.cumsum(length) - length, length)
        place = base[step] + np.repeat(rank, length)
        e = np.empty_like(emission)
        e[place] = np.exp(emission - emission.max(axis=1, keepdims=True))
        move = np.exp(self.move - self.move.max())
        alpha, beta = np.empty_like(e), np.ones_like(e)
        now = e[: active[0]] if len(active) else e
        for t, a in enumerate(active):
            here = e[base[t]: base[t] + a]
            now = here if t == 0 else (now[:a] @ move) * here
            now = now / now.sum(axis=1, keepdims=True)
            alpha[base[t]: base[t] + a] = now
        pairs = np.zeros_like(move)
        for t in range(len(active) - 2, -1, -1):
            a = active[t + 1]
            ahead = e[base[t + 1]: base[t + 1] + a] * beta[base[t + 1]: base[t + 1] + a]
            back = ahead @ move.T
            total = (alpha[base[t]: base[t] + a] * back).sum(axis=1, keepdims=True)
            pairs += move * (alpha[base[t]: base[t] + a].T @ (ahead / total))
            beta[base[t]: base[t] + a] = back / back.sum(axis=1, keepdims=True)
        both = alpha * beta
        both /= both.sum(axis=1, keepdims=True)
        return both[place], pairs

    def train(self, vocabulary: list[str], sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.2) -> None:
        """Gradient ascent on the log-likelihood with a step for each weight that falls as it is used.

        A sequence is its words' places in ``vocabulary`` and their languages.
        """
        rng, used = np.random.default_rng(0), np.full(self.weight.shape, 1.0, np.float32)
        used_c, used_m = np.full(self.common.shape, 1.0), np.full(self.move.shape, 1.0)
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for low in range(0, len(order), batch):
                some = [sequences[i] for i in order[low: low + batch]]
                place, at = np.unique(np.concatenate([w for w, _ in some]), return_inverse=True)
                words = [vocabulary[k] for k in place]
                features = list(_features(words))
                gold = np.concatenate([k for _, k in some])
                length = np.array([len(k) for _, k in some])
                got, pairs = self.marginals(self.emissions(words, features)[at], length)
                miss = -got
                miss[np.arange(len(gold)), gold] += 1
                miss = np.stack([np.bincount(at, x, len(words)) for x in miss.T], axis=1).astype(np.float32)
                first = np.zeros(len(gold), bool)
                first[np.cumsum(length) - length] = True
                follow = np.flatnonzero(~first)
                seen = np.zeros_like(self.move)
                np.add.at(seen, (gold[follow - 1], gold[follow]), 1)
                step = np.zeros_like(self.weight)
                for at, columns in features:
                    for h, v in columns:
                        np.add.at(step, h, miss[at] * np.float32(v))
                touched = np.flatnonzero(step.any(axis=1))
                used[touched] += step[touched] ** 2
                self.weight[touched] += rate * step[touched] / np.sqrt(used[touched])
                for weight, total, grad in ((self.common, used_c, self._known(words).T @ miss), (self.move, used_m, seen - pairs)):
                    total += grad**2
                    weight += rate * grad / np.sqrt(total)


def _sequences(rows: pd.DataFrame, langs: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Vocabulary and sequences of whole texts: their runs, some joined with runs of other texts."""
    rng = np.random.default_rng(int(rows["part"].iloc[0]))
    seen: dict[str, int] = {}
    pieces = []
    for text, lang in zip(rows["text"], rows["lang"]):
        at = np.array([seen.setdefault(w, len(seen)) for w in words_of(text)], np.int32)
        for low in range(0, len(at), RUN_WORDS):
            run = at[low: low + RUN_WORDS]
            pieces.append((run, np.full(len(run), langs.index(lang))))
    rng.shuffle(pieces)
    out, k = [], 0
    while k < len(pieces):  # a third of the runs stand alone, the others switch once or twice
        n = int(rng.integers(1, 4))
        out.append(tuple(np.concatenate(x) for x in zip(*pieces[k: k + n])))
        k += n
    return list(seen), out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    """A field from labelled ``docs`` (doc_id, text, lang); None if there are none."""
    known = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"), F.xxhash64("doc_id", "text").alias("h"))
    # a language's rows are thinned by their hash to about twice the sample before the window sees them
    share = keep(known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * sample + 100) / F.count("*")).alias("share")), "shares")
    u = F.col("h") / F.lit(2.0**64) + 0.5
    near = known.join(small(share), "lang").where(u <= F.col("share"))
    rank = Window.partitionBy("lang").orderBy("h", "text")
    picked = near.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= sample).select("text", "lang", F.pmod("h", F.lit(PARTS)).cast("int").alias("part"))
    picked = keep(picked, "sample")
    langs = sorted(r[0] for r in picked.select("lang").distinct().collect())
    if not langs:
        return None

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = Counter((lang, w) for text, lang in zip(pdf["text"], pdf["lang"]) for w in set(words_of(text)))
            yield pd.DataFrame([(k[0], k[1], n) for k, n in c.items()], columns=["lang", "word", "n"])

    often = picked.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    lexicon: dict[str, list[int]] = {}
    for lang, word in often.withColumn("r", F.row_number().over(first)).where(F.col("r") <= LEXICON).select("lang", "word").collect():
        lexicon.setdefault(word, []).append(langs.index(lang))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        field = Field(langs, lexicon)
        field.train(*_sequences(pdf.sort_values(["lang", "text"]), langs))
        return pd.DataFrame({"n": [len(pdf)], "weight": [field.weight.tobytes()], "common": [field.common.tobytes()], "move": [field.move.tobytes()]})

    field, total = Field(langs, lexicon), 0
    for n, *parts in picked.groupBy("part").applyInPandas(train, "n long, weight binary, common binary, move binary").collect():
        total += n
        for mine, raw in zip((field.weight, field.common, field.move), parts):
            mine += n * np.frombuffer(raw, np.float32).reshape(mine.shape)
    for mine in (field.weight, field.common, field.move):
        mine /= total
    return field


def predicted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_words, segments) of each row of ``docs``.

    ``segments`` labels every word: lang:start:end of each run of words of one language, comma-joined,
    with word numbers from 0 and the end exclusive.
    """
    held_out = remainder("doc_id", 4) == 2
    field = fit(docs.where(~held_out), sample)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    if field is None:
        return source.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.lit("").alias("segments"))
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()), ("segments", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        place: dict[str, int] = {}
        table = np.zeros((0, len(field.langs)), np.float32)

        def judged(texts: list[list[str]]) -> tuple[list[str], list[float], np.ndarray, list[str]]:
            nonlocal table
            if len(place) > 300_000:
                place.clear()
                table = table[:0]
            new = list({w for x in texts for w in x}.difference(place))
            if new:
                place.update(zip(new, range(len(table), len(table) + len(new))))
                table = np.concatenate([table, field.emissions(new)])
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            full = np.flatnonzero(length)
            langs, scores, segments = ["und"] * len(texts), [0.0] * len(texts), [""] * len(texts)
            if len(full):
                at = np.fromiter((place[w] for x in texts for w in x), np.int64, length.sum())
                got, _ = field.marginals(table[at], length[full])
                first = np.cumsum(length[full]) - length[full]
                mean = np.add.reduceat(got.astype(np.float64), first) / length[full, None]
                best = got.argmax(axis=1)
                for d, low, k, share in zip(full, first, mean.argmax(axis=1), mean.max(axis=1)):
                    langs[d], scores[d] = field.langs[k], float(min(1.0, share))
                    mine = best[low: low + length[d]]
                    cut = [0, *(np.flatnonzero(mine[1:] != mine[:-1]) + 1).tolist(), len(mine)]
                    segments[d] = ",".join(f"{field.langs[mine[a]]}:{a}:{b}" for a, b in zip(cut, cut[1:]))
            return langs, scores, length, segments

        for batch in batches:
            words, low, held = [], 0, 0
            texts = batch.column(1)
            for i in range(batch.num_rows):
                words.append(words_of(texts[i].as_py()))
                held += len(words[-1])
                if held >= TOKENS or i == batch.num_rows - 1:
                    langs, scores, length, segments = judged(words)
                    part = batch.slice(low, len(words))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(length, pa.int64()), pa.array(segments, pa.string())], schema=schema)
                    words, low, held = [], i + 1, 0

    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, segments string")
