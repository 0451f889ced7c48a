"""Clusters, fill-in-the-middle and toxic spans against plain forms, and on edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException

from sitesight.llm import fill_middle, table_clusters, toxicity
from tests.compare import compare, connect


def test_clusters_match_sql(spark, sf_dir):
    con = connect(sf_dir)
    assert compare(table_clusters.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), con, table_clusters.duckdb_sql()) is None


def plain_clusters(rows, k, rounds, dims):
    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(q, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def best(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, m)), c) for c, m in enumerate(centres))

    for _ in range(rounds):
        of = [best(v)[1] for _, v in q]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(q, of) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((str(i), *best(v)[::-1]) for i, v in q), centres


@pytest.mark.parametrize("spread", [0.01, 1.0, 300.0])
def test_clusters_plain(spark, spread):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, spread) for _ in range(3)]) for i in range(150)] + [(i % 7, [0.25, -0.25, 1e-9]) for i in range(40)]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [float("inf"), 1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (3, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as q", "'x' as vec")
    got, centres = table_clusters.cluster(df, k=9, rounds=4, dims=3)
    want, want_centres = plain_clusters(rows, 9, 4, 3)
    assert centres.tolist() == want_centres
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want


def test_clusters_edges(spark):
    shape = "vec_id long, embedding array<float>"
    assert table_clusters.clusters(spark.createDataFrame([], shape)).count() == 0
    few = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [0.0] * 64)], shape)
    got = {(r.vec_id, r.distance, r.inertia) for r in table_clusters.clusters(few).collect()}
    assert got == {(1, 0, 0), (2, 0, 0)}
    with pytest.raises(SparkRuntimeException, match="component"):
        table_clusters.clusters(spark.createDataFrame([(1, [1e30] * 64)], shape)).count()


def plain_filled(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, hexed = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k: 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_matches_sql(spark, sf_dir):
    assert compare(fill_middle.digests(spark.read.parquet(f"{sf_dir}/documents.parquet")), connect(sf_dir), fill_middle.duckdb_sql()) is None


def test_fill_middle_plain(spark, monkeypatch):
    """Blocks and pieces of many sizes, so that runs of letters cross their borders."""
    rng = random.Random(8)
    bits = ["a", "bc", "Z" * 9, "é", "😀", " ", "\n", "\x00", "<", "P>", "<P>", "1", "ſ", "K", "İ", "é"]
    weights = [9, 9, 3, 3, 3, 6, 2, 1, 1, 1, 0.02, 2, 1, 1, 1, 1]
    rows = [(k, "".join(rng.choices(bits, weights, k=rng.randint(0, 60)))) for k in range(1500)]
    rows += [(-1, None), (-2, ""), (None, "null id"), (5, "again"), (5, "again"), (-3, "x" * 30_000), (-4, "ab1 " * 20_000), (-5, "<M>" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' as n", "1 as form", "2 as h1", "3 as output")
    got = fill_middle.restored(fill_middle.filled(df)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter((d, *plain_filled(d, t)) for d, t in rows)
    assert {(r.doc_id, r.text) for r in got} == {(d, t or "") for d, t in rows} and len(got) == len(rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, piece", [(1, 4), (2, 6), (3, 3), (7, 28), (4096, 1 << 20)])
def test_fenwick_boundaries(monkeypatch, block, piece):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    rng = random.Random(block)
    texts = ["".join(rng.choices(["a", "B", "é", " ", "😀", "1"], [6, 3, 1, 2, 1, 1], k=n)) for n in (0, 1, 2, 5, 13, 64, 100)] + ["a" * 50]
    for text, counts in zip(texts, fill_middle.block_counts(texts)):
        starts = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
        tree = fill_middle.Fenwick(counts)
        assert tree.total() == (len(starts) - 1, len(text))
        assert [fill_middle.boundary(text, tree, k) for k in range(len(starts))] == starts


def enumerated(unary, move):
    """Marginals and expected moves of one short text by listing every tagging."""
    n, total, p, pairs = len(unary), 0.0, np.zeros(len(unary)), np.zeros((2, 2))
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        w = np.exp(sum(u for u, t in zip(unary, y) if t) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += w
        p += w * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += w
    return p / total, pairs / total


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    move, lengths = rng.normal(0, 1.5, (2, 2)), [1, 3, 8, 2, 1, 9, 7]
    unary = [rng.normal(0, 2, n) for n in lengths]
    first = np.concatenate([np.arange(n) == 0 for n in lengths])
    p, pairs = toxicity.marginals(np.concatenate(unary), move, first)
    want = [enumerated(u, move) for u in unary]
    assert np.allclose(p, np.concatenate([w for w, _ in want]), atol=1e-12)
    assert np.allclose(pairs, sum(w for _, w in want), atol=1e-12)


def test_marginals_of_long_texts():
    """The scan against the plain recursion over 10,000 tokens."""
    rng = np.random.default_rng(3)
    unary, move = rng.normal(-2, 3, 10_000), rng.normal(0, 2, (2, 2))
    first = np.arange(10_000) == 0
    e = np.exp(np.stack([np.zeros(10_000), unary], 1))
    alpha, beta = np.empty((10_000, 2)), np.ones((10_000, 2))
    for t in range(10_000):
        alpha[t] = e[t] * (alpha[t - 1] @ np.exp(move) if t else 1)
        alpha[t] /= alpha[t].sum()
    for t in range(9_998, -1, -1):
        beta[t] = np.exp(move) @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    both = alpha * beta
    p, _ = toxicity.marginals(unary, move, first)
    assert np.allclose(p, both[:, 1] / both.sum(axis=1), atol=1e-10)


def test_features_tell_words_apart():
    words = ["idiot", "idiots", "idiot", "ab", "a", "xidiot", "ñandú"]
    row, hashed, value = toxicity.features(words)
    of = [sorted(zip(hashed[row == k].tolist(), value[row == k].tolist())) for k in range(len(words))]
    assert of[0] == of[2] and all(of[i] != of[j] for i in range(len(words)) for j in range(i) if words[i] != words[j])
    shared = {h for h, _ in of[0]} & {h for h, _ in of[1]}
    assert len(shared) >= 4 and not {h for h, _ in of[3]} & {h for h, _ in of[6]}
    alone = toxicity.features(["idiots"])
    assert sorted(zip(alone[1].tolist(), alone[2].tolist())) == of[1]  # a word's features do not depend on its neighbours


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def planted(n=900, seed=6):
    """Invented prose; toxic texts hold words with one of two stems and any ending, or a fixed word."""
    rng = random.Random(seed)
    parts = ["ba", "lo", "mi", "ter", "sun", "vo", "ke", "ra", "ni", "plo"]
    word = lambda: "".join(rng.choices(parts, k=rng.randint(1, 3)))
    docs, labels, spans = [], [], {}
    for d in range(n):
        words, toxic = [word() for _ in range(rng.randint(20, 120))], int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["grizzat" + word(), "Hruntof" + word(), "blegh"]))
        text, at, bad = "", 0, []
        for w in words:
            if re.match("grizzat|Hruntof|blegh", w):
                bad.append((len(text), len(text) + len(w)))
            text += w + rng.choice([" ", ", ", ".\n", " – "])
        docs.append((d, text))
        labels.append((d, toxic))
        spans[d] = bad
    return docs, labels, spans


def test_toxic_spans(spark):
    docs, labels, spans = planted()
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got.keys() == {d for d, _ in docs}
    held = [(d, y) for d, y in labels if crc(d) % 5 == 0]
    assert all(got[d].held_out for d, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[d].predicted == y for d, y in held]) >= 0.97
    found = {(d, s) for d, r in got.items() if r.held_out for s in ((x.start, x.end) for x in r.spans)}
    want = {(d, s) for d, _ in held for s in spans[d]}
    covered = {(d, s) for d, s in want if any(e == d and low <= s[0] and s[1] <= high for e, (low, high) in found)}
    assert len(covered) >= 0.95 * len(want) and len(found) <= 1.1 * len(want)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_toxicity_edges(spark):
    docs, labels, _ = planted(300, 9)
    labels += [(1, 1 - labels[1][1]), (2, None), (None, 1), (7777, 1), (3, 5)]
    docs += [(9001, None), (9002, ""), (9003, " \n!? "), (None, "blegh blegh"), (5, docs[5][1]), (9004, "bablegh " * 50_000), (9005, "x" * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as toxic", "'p' as part", "0 as h", "1 as x", "2 as spans", "'s' as score")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'a' as text", "1 as y")
    rows = toxicity.scored(df, lab).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in docs)
    by = {r.doc_id: r for r in rows}
    assert by[9001].score == by[9002].score == by[9003].score < 0.5 and by[9001].n_tokens == 0 and by[9001].spans == []
    assert len({(r.score, str(r.spans)) for r in rows if r.doc_id == 5}) == 1 and by[9004].n_tokens == 50_000
    assert toxicity.scored(df.limit(0), lab).count() == 0
    alone = toxicity.scored(df, lab.where("toxic = 0")).collect()
    assert all(r.score == 0 and r.predicted == 0 and r.spans == [] for r in alone) and len(alone) == len(docs)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.scored(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).select("doc_id", "held_out", "predicted")
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.9


@pytest.mark.parametrize("text, words", [("5 m²", ["m"]), ("x½", ["x"]), ("½ 5 _", []), ("Über²all", ["über", "all"]), ("été", ["été"]), (None, [])])
def test_words_are_runs_of_letters(text, words):
    from sitesight.llm import language_crf

    assert language_crf.words_of(text) == words
