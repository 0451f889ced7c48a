"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage.

Weights are BM25 weights divided by the item's own total, so a score is the share of an item's
BM25 mass that a passage holds, and one threshold serves items of any length. Passages are
windows of twice the items' length, half overlapping, over whole documents, so an item's copy
lies in one passage whole.

Retrieval is block-max WAND. All passages of a batch take the first step together: the block
maxima of their rare terms plus a block's largest sum over common terms bound every score in the
block; passages below the threshold in every block have no pivot. The others run the pivot loop.
Nothing at or above the threshold is lost, because both steps only compare upper bounds.

A retrieved pair is verified on the words: the share of the question's word triples that the
passage holds, and of the answer's. An item without an answer column is cut in the middle.

The index is built by Spark and goes to the tasks in shards of about ``SHARD_WORDS`` words of
items of similar length; documents are read once per shard. Null or wordless items and texts match
nothing; repeated items match alike; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitesight.llm.common import per_batch
from sitesight.workspace import keep

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.5
BLOCK_ITEMS, SHARD_WORDS = 4, 2_000_000
_WORDS = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


class ItemIndex:
    """The postings of one shard: rows (item_id, question, answer, terms, weights)."""

    def __init__(self, rows: list[tuple], threshold: float):
        rows = sorted(rows, key=lambda r: (len(r[3]), r[0]))
        self.rows, self.threshold = rows, threshold
        self.parts = [[set(zip(*[p[k:] for k in range(3)])) or {tuple(p)} for p in (list(r[1]), list(r[2]))] for r in rows]
        self.term: dict[str, int] = {}
        self.docs: list[list[int]] = []
        self.weight: list[list[float]] = []
        for d, row in enumerate(rows):
            for t, w in zip(row[3], row[4]):
                if t not in self.term:
                    self.term[t] = len(self.docs)
                    self.docs.append([])
                    self.weight.append([])
                self.docs[self.term[t]].append(d)
                self.weight[self.term[t]].append(w)
        self.upper = [max(w) for w in self.weight]
        self.block: list[dict[int, float]] = []
        for docs, ws in zip(self.docs, self.weight):
            top: dict[int, float] = {}
            for d, w in zip(docs, ws):
                top[d // BLOCK_ITEMS] = max(w, top.get(d // BLOCK_ITEMS, 0.0))
            self.block.append(top)
        # common terms: the longest posting lists, while no item has 0.4 of the threshold in them
        self.blocks = len(rows) // BLOCK_ITEMS + 1
        mass, self.rare = np.zeros(len(rows)), np.ones(len(self.docs), bool)
        for t in sorted(range(len(self.docs)), key=lambda t: -len(self.docs[t])):
            more = mass[self.docs[t]] + self.weight[t]
            if len(self.docs[t]) < 2 or more.max() > 0.4 * threshold:
                continue
            mass[self.docs[t]] = more
            self.rare[t] = False
        self.common = np.array([mass[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].max(initial=0.0) for b in range(self.blocks)])
        sizes = [len(x) if r else 0 for x, r in zip(self.block, self.rare)]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = [(b, w) for x, r in zip(self.block, self.rare) if r for b, w in x.items()]
        self.flat_block = np.array([b for b, _ in flat], np.int64)
        self.flat_top = np.array([w for _, w in flat])

    def hopeful(self, terms: np.ndarray, chunk: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Chunks that may begin a passage with a pivot; a passage is a chunk and the next if that follows in its document."""
        n = len(follows)
        count = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        cell = np.repeat(chunk, count) * self.blocks + self.flat_block[at]
        bound = np.bincount(cell, self.flat_top[at], n * self.blocks).reshape(n, self.blocks)
        bound[:-1] += bound[1:] * follows[:-1, None]
        return np.flatnonzero((bound + self.common >= self.threshold - 1e-9).any(axis=1))

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """All items whose score over ``terms`` is at least the threshold, by block-max WAND."""
        need, found = self.threshold - 1e-9, []
        lists = [[self.docs[t][0], 0, t] for t in terms]
        while True:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                total += self.upper[t]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                return found
            d = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == d:
                pivot += 1
            b = d // BLOCK_ITEMS
            if sum(self.block[x[2]].get(b, 0.0) for x in lists[: pivot + 1]) < need:
                goal = min((b + 1) * BLOCK_ITEMS, lists[pivot + 1][0] if pivot + 1 < len(lists) else len(self.rows))
            elif lists[0][0] == d:
                score = sum(self.weight[t][at] for _, at, t in lists[: pivot + 1])
                if score >= need:
                    found.append((d, score))
                goal = d + 1
            else:
                goal = d
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    x[1] = bisect_left(self.docs[x[2]], goal, x[1])
                    x[0] = self.docs[x[2]][x[1]] if x[1] < len(self.docs[x[2]]) else -1
            lists = [x for x in lists if x[0] >= 0]

    def overlaps(self, item: int, passage: list[str]) -> tuple[float, float]:
        held = set(zip(passage, passage[1:], passage[2:]))
        whole = set(passage)
        share = [sum(g in held if len(g) == 3 else set(g) <= whole for g in part) / len(part) for part in self.parts[item]]
        return share[0], share[1]


def _matches(index: ItemIndex, half: int, ids: list, texts: list) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "score", "question_overlap", "answer_overlap")}
    room = max(1, 4_000_000 // index.blocks)
    get = index.term.get
    waiting: list[tuple] = []

    def flush() -> None:
        first = np.cumsum([0] + [max(1, -(-len(w) // half)) for _, w, _ in waiting])
        follows = np.ones(first[-1], bool)
        follows[first[1:] - 1] = False
        terms = np.concatenate([t for _, _, t in waiting])
        chunk = np.concatenate([first[k] + np.arange(len(t)) // half for k, (_, _, t) in enumerate(waiting)])
        hit = terms >= 0
        terms, chunk = terms[hit], chunk[hit]
        rare = index.rare[terms]
        once = np.unique(chunk[rare] * len(index.docs) + terms[rare])
        hopeful = index.hopeful(once % len(index.docs), once // len(index.docs), follows)
        best: dict[tuple[int, int], tuple] = {}
        for c, k in zip(hopeful, np.searchsorted(first, hopeful, "right") - 1):
            low = (c - first[k]) * half
            seen = {int(t) for t in waiting[k][2][low: low + 2 * half] if t >= 0}
            for item, score in index.wand(seen):
                a, b = index.overlaps(item, waiting[k][1][low: low + 2 * half])
                best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (min(a, b), a, b, score))
        for (k, item), (_, a, b, score) in best.items():
            for name, v in zip(out, (waiting[k][0], index.rows[item][0], score, a, b)):
                out[name].append(v)
        waiting.clear()

    held = 0
    for i, text in zip(ids, texts):
        words = words_of(text)
        if words:
            waiting.append((i, words, np.fromiter((get(w, -1) for w in words), np.int64, len(words))))
            held += len(words) // half + 1
        if held > room or len(waiting) >= 400:
            flush()
            held = 0
    if waiting:
        flush()
    return out


def item_postings(items: DataFrame) -> DataFrame:
    """(item_id, question, answer, terms, weights, band): words and normalised BM25 weights of each item."""
    has_answer = "answer" in items.columns
    question, answer = ("question", "answer") if has_answer else ("text", None)
    schema = pa.schema([("item_id", pa.int64()), ("question", pa.list_(pa.string())), ("answer", pa.list_(pa.string()))])

    def work(batch: pa.RecordBatch) -> dict:
        q = [words_of(t) for t in batch.column(1).to_pylist()]
        a = [words_of(t) for t in batch.column(2).to_pylist()]
        if not has_answer:
            q, a = [w[: (len(w) + 1) // 2] for w in q], [w[(len(w) + 1) // 2:] for w in q]
        return {"item_id": batch.column(0), "question": q, "answer": a}

    columns = [F.col("item_id").cast("long"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a") if answer else F.lit(None).cast("string").alias("a")]
    cut = keep(items.select(*columns).mapInArrow(per_batch(work, schema), "item_id long, question array<string>, answer array<string>"), "items")
    cut = cut.where("size(question) + size(answer) > 0").withColumn("row", F.xxhash64("item_id", "question", "answer"))
    terms = cut.select("row", "item_id", "question", "answer", F.explode(F.concat("question", "answer")).alias("term"))
    tf = terms.groupBy("row", "term").agg(F.count("*").alias("tf")).join(terms.groupBy("term").agg(F.countDistinct("row").alias("df")), "term")
    n, mean = cut.agg(F.countDistinct("row"), F.avg(F.size("question") + F.size("answer"))).first()
    length = cut.groupBy("row").agg(F.max(F.size("question") + F.size("answer")).alias("length"), F.count("*").alias("copies"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") / F.col("copies")
    weighted = tf.join(length, "row").withColumn("w", idf * part * (K1 + 1) / (part + K1 * (1 - B + B * F.col("length") / F.lit(mean or 1.0))))
    listed = weighted.groupBy("row").agg(F.sum("w").alias("total"), F.sort_array(F.collect_list(F.struct("term", "w"))).alias("p"), F.max("length").alias("length"))
    listed = listed.select("row", F.col("p.term").alias("terms"), F.transform("p.w", lambda w: w / F.col("total")).alias("weights"), F.ceil(F.log2("length")).cast("int").alias("band"))
    return cut.join(listed, "row").drop("row").distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of all verified pairs."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    postings = keep(item_postings(items), "postings")
    # the bands bound the passage; a band above shard_words is cut into shards
    bands = postings.groupBy("band").agg(F.sum(F.size("question") + F.size("answer")).alias("words"), F.max(F.size("question") + F.size("answer")).alias("longest"))
    small = bands.withColumn("group", F.when(F.col("band") <= 6, 6).otherwise(F.col("band"))).groupBy("group").agg(F.sum("words").alias("words"), F.max("longest").alias("longest"))
    found = spark.createDataFrame([], ddl)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for group, words, longest in small.orderBy("group").collect():
        shards = -(-words // shard_words)
        for shard in range(shards):
            mine = postings.where((F.greatest(F.col("band"), F.lit(6)) == group) & (F.pmod(F.xxhash64("item_id", "terms"), F.lit(shards)) == shard))
            held = spark.sparkContext.broadcast([tuple(r) for r in mine.select("item_id", "question", "answer", "terms", "weights").collect()])
            half = max(32, longest)

            def search(batches, held=held, half=half):
                if not held.value:
                    return
                index = ItemIndex(held.value, threshold)
                yield from per_batch(lambda b: _matches(index, half, b.column(0).to_pylist(), b.column(1).to_pylist()), schema)(batches)

            found = found.union(source.mapInArrow(search, ddl))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc(F.least("question_overlap", "answer_overlap")), F.desc("score"))
    found = found.where((F.col("question_overlap") >= overlap) & (F.col("answer_overlap") >= overlap))
    return found.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")
