"""Near-duplicate documents: a chosen-path join on word shingles.

A text is its set of 5-word shingles (lower-cased ``\\w+`` words; fewer than 5 words make one
shingle). Texts with equal sets are one node, so copies never meet as pairs. A run splits the
nodes by a sampled shingle they share (the least under the run's hash, so that two sets choose
the same one with the probability of their similarity). A bucket of at most ``BUCKET`` nodes is
compared whole; a larger one is split again by the run's next sample, up to ``DEPTH`` times, and
what is still larger is compared in blocks of ``BUCKET``, each pair of blocks its own group.
The number of runs follows from ``RECALL``: 1 - (1 - t^DEPTH)^runs at similarity t.

Comparison is exact Jaccard on the whole sets. A pair counts in the first run in which it meets,
and buckets whose members all met in one earlier run are skipped. A group returns link counts
and a forest of its links, never its pairs.

Null texts and texts without words are alone in their class. Repeated rows are copies. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesight.llm.common import components, per_batch, small
from sitesight.llm.decontaminate import words_of
from sitesight.workspace import keep, spread

SIMILARITY, WORDS = 0.8, 5
BUCKET, DEPTH, RECALL = 256, 3, 0.999
_MIX = np.random.default_rng(5).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def runs_for(similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(0.999, similarity**depth))))


def shingles(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """The sorted distinct 64-bit shingles of one text; ``seen`` caches word hashes."""
    if len(seen) > 400_000:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = (x ^ h[k: len(h) - n + 1 + k]) * _MIX[k]
        x ^= x >> np.uint64(29)
    return np.unique(x)


def _signatures(docs: DataFrame, runs: int) -> DataFrame:
    """(doc_id, digest, sig): digest of the set, null without words; runs x DEPTH sampled shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int64()))])
    factors = _MIX[64: 64 + runs * DEPTH, None]
    seen: dict[str, int] = {}

    def work(batch: pa.RecordBatch) -> dict:
        digests, sigs = [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            if not words:
                digests.append(None)
                sigs.append(None)
                continue
            x = shingles(words, seen)
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            least = np.minimum.reduce([(x[k: k + 4096] * factors).min(axis=1) for k in range(0, len(x), 4096)])
            sigs.append(least.view(np.int64))
        return {"doc_id": batch.column(0), "digest": digests, "sig": sigs}

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(per_batch(work, schema), "doc_id long, digest binary, sig array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(digest, set): the shingles of each row as bytes."""
    seen: dict[str, int] = {}

    def work(batch: pa.RecordBatch) -> dict:
        found = [shingles(w, seen).tobytes() for w in map(words_of, batch.column(1).to_pylist()) if w]
        return {"digest": [hashlib.blake2b(x, digest_size=16).digest() for x in found], "set": found}

    schema = pa.schema([("digest", pa.binary()), ("set", pa.binary())])
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(per_batch(work, schema), "digest binary, set binary")


def _links(sets: list[np.ndarray], side: np.ndarray, leaves: np.ndarray, run: int, similarity: float) -> np.ndarray:
    """Which members of a group are linked and did not meet before: a symmetric boolean matrix."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(shared.sum()), 16_384):
        a, b = np.searchsorted(column, (low, low + 16_384))
        part = np.zeros((n, 16_384), np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None, :]
    for r in range(run):
        x = leaves[:, r]
        linked &= ~((x[:, None] == x[None, :]) & (x != 0)[:, None])
    return linked


def _compare(similarity: float):
    schema = pa.schema([("digest", pa.binary()), ("other", pa.binary()), ("links", pa.int64()), ("texts", pa.int64())])

    def group(rows: list[dict], out: dict) -> None:
        sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
        copies = np.array([r["copies"] for r in rows])
        leaves = np.array([r["leaves"] for r in rows], np.int64)
        linked = _links(sets, np.array([r["side"] for r in rows]), leaves, rows[0]["run"], similarity)
        label = np.arange(len(rows))
        while True:  # the least member that links reach
            low = np.minimum(label, np.where(linked, label[None, :], len(rows)).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        texts, links = linked.sum(axis=1), linked @ copies
        for k in np.flatnonzero(texts):
            out["digest"].append(rows[k]["digest"])
            out["other"].append(rows[label[k]]["digest"])
            out["links"].append(int(links[k]))
            out["texts"].append(int(texts[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for low in range(0, batch.num_rows, 256):
                for row in batch.slice(low, 256).to_pylist():
                    if held and held[0]["bucket"] != row["bucket"]:
                        group(held, out)
                        held = []
                    held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        if held:
            out = {f.name: [] for f in schema}
            group(held, out)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def _leaves(nodes: DataFrame, runs: int) -> DataFrame:
    """(digest, run, leaf, size): the bucket in which a node ends in each run, where it has company."""
    rows = nodes.select("digest", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, F.get("sig", r * DEPTH)))).alias("run", "leaf"))
    done = []
    for depth in range(1, DEPTH + 1):
        sizes = keep(rows.groupBy("leaf").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        met = keep(rows.join(small(sizes), "leaf"), "met")
        done.append(met if depth == DEPTH else met.where(F.col("size") <= BUCKET))
        rows = met.where(F.col("size") > BUCKET).select("digest", "run", "leaf")
        if depth == DEPTH or rows.isEmpty():
            break
        deeper = rows.join(nodes.select("digest", "sig"), "digest")
        rows = deeper.select("digest", "run", F.xxhash64("leaf", F.get("sig", F.col("run") * DEPTH + depth)).alias("leaf"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return keep(out, "leaves")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, n_texts), a row for each row of ``docs``.

    ``class_id`` is the least doc_id of all documents that links reach, ``n_links`` the number of
    other documents at ``similarity`` or more, copies included, ``n_texts`` that of different sets.
    """
    runs = runs_for(similarity, recall)
    rows = keep(_signatures(docs, runs), "signatures")
    nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    nodes = keep(nodes, "nodes")
    leaves = _leaves(nodes, runs)

    place = F.map_from_entries(F.collect_list(F.struct("run", "leaf")))
    path = leaves.groupBy("digest").agg(place.alias("m")).select("digest", F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.coalesce(F.try_element_at(F.col("m"), r), F.lit(0))).alias("leaves"))
    member = keep(leaves.join(path, "digest"), "members")
    earlier = [x for r in range(runs) for x in (F.min(F.get("leaves", F.lit(r))).alias(f"a{r}"), F.max(F.get("leaves", F.lit(r))).alias(f"b{r}"))]
    whole = member.groupBy("run", "leaf").agg(*earlier)
    known = F.lit(False)
    for r in range(runs):
        known = known | ((F.col("run") > r) & (F.col(f"a{r}") == F.col(f"b{r}")) & (F.col(f"a{r}") != 0))
    todo = keep(whole.where(~known).select("run", "leaf"), "buckets")
    member = member.join(small(todo), ["run", "leaf"], "left_semi")

    chunks = F.ceil(F.col("size") / BUCKET).cast("int")
    mine = F.pmod(F.xxhash64("digest", "leaf"), F.col("chunks")).cast("int")
    member = member.withColumn("chunks", chunks).withColumn("c", mine).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    bucket = F.xxhash64("run", "leaf", F.least("c", "k"), F.greatest("c", "k"))
    member = keep(member.select("digest", "run", "leaves", bucket.alias("bucket"), (F.col("c") > F.col("k")).cast("int").alias("side"), "size"), "groups")

    needed = keep(member.select("digest").distinct(), "needed")
    chosen = keep(nodes.join(small(needed), "digest", "left_semi").select("digest", "doc", "copies"), "chosen")
    ids = small(chosen.select(F.col("doc").alias("_d")).distinct())
    picked = docs.select("doc_id", "text").join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")), "left_semi")
    sets = _sets(picked).groupBy("digest").agg(F.first("set").alias("set")).join(small(chosen.select("digest", "copies")), "digest")
    sets = keep(sets, "sets")
    grouped = spread(member.join(sets, "digest"), "bucket").sortWithinPartitions("bucket")
    compared = keep(grouped.select("bucket", "run", "side", "digest", "copies", "leaves", "set").mapInArrow(
        _compare(similarity), "digest binary, other binary, links long, texts long"), "compared")

    counts = compared.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    labels = components(compared.select(F.col("digest").alias("a"), F.col("other").alias("b")))
    labelled = nodes.select("digest", "doc", "copies").join(labels.withColumnRenamed("node", "digest"), "digest", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "digest"))
    least = labelled.groupBy("label").agg(F.min("doc").alias("class_id"))
    nodes = labelled.join(least, "label").join(counts, "digest", "left").select(
        "digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    out = rows.select("doc_id", "digest").join(small(keep(nodes, "classes")), "digest", "left")
    alone = F.col("digest").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_texts", F.lit(0).cast("long")).alias("n_texts"))
