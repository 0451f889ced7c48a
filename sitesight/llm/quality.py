"""Quality scores from preference pairs (Bradley-Terry), cut at a quantile of the scores.

A document is a vector of text measures. Each labelled poor document meets a fixed number of
labelled good ones; the logistic loss on the difference of their measures (no intercept) is the
Bradley-Terry likelihood of "the good one wins" with strengths linear in the measures. The cut
is the quantile of the labelled scores at the share of poor labels.

Null and empty texts have measures too (all zero but ``empty``). Columns other than the id and
the text are ignored. Without labels of both kinds no document is rejected (score 0.7).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesight.llm.common import per_batch, remainder
from sitesight.workspace import keep

MEASURES = [
    "empty", "few_words", "long_words", "short_words", "capitals", "symbols", "marks", "bars", "digits", "top_word",
    "repeated_words", "repeated_triples", "repeated_lines", "squeezable", "no_stops", "not_ascii",
]
#: Labelled documents of each kind used for pairs, and pairs for each poor one.
SAMPLE, PAIRS = 20_000, 8
CUT = 0.7

_KIND = np.zeros((256, 7))
_KIND[65:91, 0] = 1  # capitals
_KIND[[*range(65, 91), *range(97, 123)], 1] = 1  # letters
_KIND[48:58, 2] = 1  # digits
_KIND[list(b"#$%&*@^~<>{}[]=_\\/+`"), 3] = 1  # symbols
_KIND[list(b"!?"), 4] = 1  # marks
_KIND[list(b"|"), 5] = 1  # bars
_KIND[128:, 6] = 1  # beyond ASCII


def measures(text: str | None) -> list[float]:
    """The measures of one whole text, each between 0 and 1."""
    raw = (text or "").encode("utf-8", "ignore")
    words = raw.lower().split()
    if not words:
        return [1.0] + [0.0] * (len(MEASURES) - 1)
    n = len(words)
    capital, letter, digit, symbol, mark, bar, beyond = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KIND
    size = len(raw)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x]
    triples = max(1, n - 2)
    ends = sum(raw.count(x) for x in (b". ", b".\n", b", "))
    mean = size / n
    up = lambda x, full: min(1.0, x / full)
    return [
        0.0, up(max(0, 12 - n), 12), up(max(0.0, mean - 8), 8), up(max(0.0, 5 - mean), 3), up(capital / max(1, letter), 0.5),
        up(symbol / size, 0.05), up(mark / size, 0.05), up(bar / size, 0.05), up(digit / size, 0.2), up(max(0.0, max(counts.values()) / n - 0.1), 0.4),
        up(max(0.0, 1 - len(counts) / n - 0.35), 0.5) if n >= 20 else 0.0,
        up(1 - len(set(zip(words, words[1:], words[2:]))) / triples, 0.5) if n >= 5 else 0.0,
        up(1 - len(set(lines)) / max(1, len(lines)), 0.5), up(max(0.0, 0.3 - len(zlib.compress(raw, 1)) / size), 0.3) if size >= 200 else 0.0,
        up(max(0.0, 0.03 - ends / n), 0.03) if n >= 20 else 0.0, up(beyond / size, 0.3),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of ``docs``, in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    work = per_batch(lambda b: {"doc_id": b.column(0), "x": [measures(t) for t in b.column(1).to_pylist()]}, schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, x array<double>")


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> tuple[list[float], float] | None:
    """Weights and cut from ``rows`` (doc_id, x) and ``labels`` (doc_id, quality 0 or 1).

    At most ``sample`` documents of each kind, by hash of the id, make pairs. Several labels of
    one id count as their majority, and as none if they are even. None without both kinds.
    """
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    known = keep(rows.join(one.where("q <> 0.5").select("doc_id", (F.col("q") > 0.5).alias("good")), "doc_id"), "labelled")
    order = Window.orderBy("h", "doc_id")
    picked = {
        g: known.where(F.col("good") == g).select("doc_id", "x", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
        for g in (True, False)
    }
    good = keep(picked[True].withColumn("i", F.row_number().over(order) - 1), "good")
    n_good = good.count()
    if not n_good or known.where("not good").isEmpty():
        return None
    poor = picked[False].select(
        F.col("x").alias("y"), F.explode(F.sequence(F.lit(1), F.lit(pairs))).alias("r"), "h"
    ).withColumn("i", F.pmod(F.xxhash64("h", "r"), F.lit(n_good)).cast("int"))
    sign = F.when(F.xxhash64("h", "r", F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)
    won = poor.join(good.select("i", "x"), "i").select(
        sign.alias("s"), F.zip_with("x", "y", lambda a, b: a - b).alias("d")
    )
    won = won.select(((F.col("s") + 1) / 2).alias("label"), array_to_vector(F.transform("d", lambda v: v * F.col("s"))).alias("features"))
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(keep(won, "pairs"))
    weights = [float(w) for w in model.coefficients]
    marked = known.select("good", raw_score(weights).alias("s"))
    share = marked.agg(F.avg((~F.col("good")).cast("double"))).first()[0]
    low, high = marked.agg(F.percentile_approx("s", F.array(F.lit(max(0.0, share - 0.005)), F.lit(min(1.0, share + 0.005))), 10_000)).first()[0]
    return weights, (low + high) / 2


def raw_score(weights: list[float]):
    """The Bradley-Terry strength: a weighted sum of the measures."""
    return sum((F.element_at("x", i + 1) * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): score 0.7 is the cut, higher is better."""
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    rows = keep(measured(docs).select("doc_id", "x", held), "measured")
    model = fit(rows.where("not held_out").select("doc_id", "x"), labels.select(F.col("doc_id").cast("long"), "quality"), sample)
    if model is None:
        score = F.lit(CUT)
    else:
        weights, cut = model
        score = 1 / (1 + F.exp(-(raw_score(weights) - cut) - math.log(CUT / (1 - CUT))))
    return rows.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
