"""Registered queries and operators on small tables, held against plain forms of the same result."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from sitesight.llm import decontaminate, jaccard_join, language_crf, lattice_lm, line_dedup, mixing, nearest, pii, registry
from tests.llm import plain


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang").collect()]


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def test_nearest_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [r for r in table.collect() if r.vec_id is not None]
    vector = next(k for k, t in table.dtypes if t.startswith("array"))
    rows = [r for r in rows if r[vector] and np.isfinite(np.array(r[vector], float)).all() and np.any(r[vector])]
    ids, x = np.array([r.vec_id for r in rows]), np.array([r[vector] for r in rows], float)
    got = registry.op2_nearest_neighbours(spark, sf_dir).toPandas()
    found = wanted = 0
    for q, v in zip(ids, x):
        if q % 20 == 0:
            score = np.where(ids == q, -np.inf, x @ v)
            best = ids[np.lexsort((ids, -score))][: min(20, len(ids) - 1)]
            mine = got[got["query_id"] == q]
            assert list(mine["rank"].sort_values()) == list(range(1, len(best) + 1))
            found, wanted = found + len(set(best) & set(mine["vec_id"])), wanted + len(best)
    assert wanted and found / wanted >= 0.9


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "log-normal lengths"])
def test_nearest_recall_of_shapes(spark, kind):
    """Several shards of vectors that graphs find hard: no structure, tight clusters, very unequal lengths."""
    rng, n = np.random.default_rng(5), 6000
    x = rng.normal(size=(n, 32))
    if kind == "clusters":
        x = rng.normal(size=(150, 32))[rng.integers(0, 150, n)] + 0.2 * x
    if kind == "log-normal lengths":
        x *= rng.lognormal(0, 1, size=(n, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.nearest(df, shard_rows=2000).toPandas().groupby("query_id")["vec_id"].agg(set)
    asked = np.arange(0, n, 20)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert list(got.index) == list(asked) and all(len(v) == 20 for v in got)
    assert np.mean([len(got[q] & set(b)) / 20 for q, b in zip(asked, best)]) >= 0.9


def test_nearest_repeated_rows(spark):
    """Each row is a candidate and a query of its own, also where another has its id, its vector or both."""
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 0.0]), (5, [3.0, 1.0]), (7, [-1e200, 1e-200])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = []
    for at, (q, v) in enumerate(rows):
        if q == 20:
            others = sorted((-(a * v[0] + b * v[1]), i) for k, (i, (a, b)) in enumerate(rows) if k != at)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(others)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_mixing(spark, sf_dir, rows):
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += plain.size(text)
    want = plain.targets(sizes)
    got = registry.op1_mixing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((d, plain.size(t), sizes[s]) for d, t, s, _ in rows)
    taken, smallest = Counter(), {}
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        smallest[r.source] = min(r.size or 1e9, smallest.get(r.source, 1e9))
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], smallest[s]) for s in want)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, registry.op1_mixing(spark, sf_dir).collect()))


@pytest.mark.parametrize("shards", [1, 7, 200])
def test_splitting_tree(spark, shards):
    quotas = {"a": 900, "b": 11, None: 90}
    got = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "source string, n long"), shards).collect()
    drawn, total = defaultdict(list), Counter()
    for r in got:
        drawn[r.source] += range(r.low, r.low + r.n)
        total[r.shard] += r.n
    assert all(sorted(drawn[s]) == list(range(n)) for s, n in quotas.items())  # every block once
    assert len(total) == shards and max(total.values()) - min(total.values()) <= 1


def test_base_spans(spark, sf_dir, rows):
    rng = random.Random(3)
    bits = ["a", "b.c", "@", ".", "+", "1", "23", "255", "999", " ", "-", "(", "4111 1111 1111 1111", "4111111111111111", "+49 30 123456", "10.0.0.1", "é", "😀", "\n", "x_y@", "%"]
    texts = {d: t for d, t, *_ in rows}
    got = {r.doc_id: r for r in registry.op4_pii(spark, sf_dir).collect()}
    made = {-k: "".join(rng.choices(bits, k=rng.randint(1, 25))) for k in range(1, 1500)}
    got |= {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(made.items()), "doc_id long, text string")).collect()}
    texts |= made
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        want = plain.base_spans(text)
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, want, got[d].spans)
        assert set(want) <= set(got[d].spans.split(",") if got[d].spans else [])
        assert all(got[d][f"n_{k}"] == sum(x.startswith(k) for x in want) for k in plain.BASE)


def test_pii_discovery(spark):
    """Contexts of seeds find identifiers that no base expression matches, and leave plain numbers alone."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = [f"{word()} {word()} write to user{k}@mail.example.com or {word()}" for k in range(40)]
    texts += [f"{word()} call us: +49 30 {k}555 {k}01 {word()}" for k in range(10, 40)] + [f'{word()} api_key = "{rng.getrandbits(160):040x}" {word()}' for _ in range(12)]
    unseen = {len(texts): "Mail jdoe77@intranet soon", len(texts) + 1: f"{word()} write to jdoe77@intranet or {word()}", len(texts) + 2: "an api_key = abc123abc end"}
    texts += list(unseen.values()) + [f"{word()} room {k} holds {word()} 4{k} chairs" for k in range(60)] + [f"commit {rng.getrandbits(160):040x} {word()}" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    at = lambda d, kind, piece: f"{kind}:{texts[d].index(piece)}:{texts[d].index(piece) + len(piece)}"
    first = min(unseen)
    assert at(first + 1, "email", "jdoe77@intranet") in got[first + 1].spans
    assert at(first + 2, "secret", "abc123abc") in got[first + 2].spans
    assert all(got[d].n_added == 1 and "secret:" in got[d].spans for d in range(70, 82))
    assert all(got[d].n_added == 0 for d in range(first + 3, len(texts)))
    found = pii.occurrences(pii.base_spans(docs))
    want = plain.discovered(found.collect(), pii.ROUNDS, pii.SUPPORT, pii.SCORE, pii.ALL_KINDS)
    assert {(r.doc_id, r.start, r.end, r.kind) for r in pii.discovered(found).collect()} == want and len(want) >= 14


def test_pii_long_text(spark):
    """A text of very many matches: positions over several levels of blocks, tokens that begin and do not begin spans."""
    text = " ".join(f"x{k} 10.0.{k % 256}.{k % 300} é" for k in range(20_000))
    got = pii.personal_data(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    want = plain.base_spans(text)
    assert len(got) == 2 and got[0] == got[1] and got[0].n_spans == len(want) + got[0].n_added
    assert got[0].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and len(want) > 15_000


def test_line_dedup(spark, sf_dir, rows):
    got = {r.doc_id: r.dropped for r in registry.op5_line_dedup(spark, sf_dir).collect()}
    want = plain.dropped_lines(rows)
    assert {d: x for d, x in got.items() if x} == want and want


def test_line_templates(spark):
    """Many lines that share a half, so that buckets are refined."""
    rng = random.Random(5)
    lines = ["one common half of a line " + "".join(rng.choices("ab", k=9)) for _ in range(400)] + ["".join(rng.choices("xy", k=8)) + " the other common half" for _ in range(200)]
    docs = [(k, "\n".join(lines[k::20])) for k in range(20)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.dropped for r in got if r.dropped} == plain.dropped_lines(docs)


def test_near_duplicates(spark, sf_dir, rows):
    got = {r.doc_id: (r.class_id, r.n_links) for r in registry.op9_jaccard_join(spark, sf_dir).collect()}
    assert got == plain.near_duplicates(rows)


def test_near_duplicates_hot_group(spark):
    """Variants of one text beyond a bucket, which the run splits and compares in blocks."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(700):
        w = list(base)
        w[rng.randrange(120)] = f"v{rng.randrange(40)}"
        docs.append((k, " ".join(w)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain.near_duplicates(docs)
    assert {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert sum(x[1] for x in got.values()) >= 0.999 * sum(x[1] for x in want.values())


def test_contaminated(spark, sf_dir, rows):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain.leaks(rows, decontaminate.item_postings(items).collect())
    got = {(r.doc_id, r.item_id) for r in registry.op3_decontamination(spark, sf_dir).collect()}
    assert got == want and want


def test_lattice():
    pieces = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb"]
    logp = np.log(np.arange(1, 10) / 45.0)
    got = lattice_lm.Lattice(pieces, ["normal"] * 9, logp).log_prob([b"abab", b"a", b"", b"bbabba"])
    assert got == pytest.approx([plain.all_cuts("▁" + w, dict(zip(pieces, logp))) for w in ("abab", "a", "", "bbabba")])


def test_base_scores(spark, sf_dir, rows):
    words = {d: (t or "").encode().lower().split() for d, t, *_ in rows}
    counts, ends = Counter(), 0
    for d, w in words.items():
        if remainder(d, 7) != 2:
            counts.update(w)
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for hot in (lattice_lm.HOT, 50):  # with few hot words most meet their counts in the join
        for r in lattice_lm.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), hot=hot).collect():
            seen = [counts[w] for w in words[r.doc_id]] + [ends]
            assert r.n_tokens == len(seen) and r.n_known == sum(c > 0 for c in seen) and r.train_tokens == n
            assert r.base_score == pytest.approx(sum(math.log10((c + 1) / (n + v + 1)) for c in seen), rel=1e-9)
            assert r.held_out == (remainder(r.doc_id, 7) == 2) and -math.inf < r.score < 0


def test_forward_backward():
    rng = np.random.default_rng(0)
    field = language_crf.Field(["x", "y", "z"], {})
    field.move = rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([4, 1, 3])
    emission = rng.normal(size=(8, 3)).astype(np.float32)
    got, _ = field.marginals(emission, lengths)
    at = 0
    for n in lengths:
        mass = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = math.exp(sum(emission[at + k, s] for k, s in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:])))
            for k, s in enumerate(path):
                mass[k, s] += p
        assert got[at: at + n] == pytest.approx(mass / mass.sum(axis=1, keepdims=True), rel=1e-4)
        at += n


def test_language_held_out(spark, sf_dir, rows):
    lang = {d: x for d, t, _, x in rows if x is not None and any(map(str.isalpha, t or ""))}
    got = [r for r in registry.op7_language_crf(spark, sf_dir).collect() if r.held_out and r.doc_id in lang]
    assert got and all(remainder(r.doc_id, 4) == 2 and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) >= 0.9


def test_language_learns_from_whole_texts_and_labels_words(spark):
    """Words that stand only at the end of long texts are learned; a switched text is cut where it switches."""
    made = random.Random(3)
    of = {"aa": ["".join(made.choices("abcd", k=6)) for _ in range(80)], "zz": ["".join(made.choices("wxyz", k=6)) for _ in range(80)]}
    late = {"aa": "qqkk", "zz": "kkqq"}
    docs = []
    for k in range(80):
        lang = ("aa", "zz")[k % 2]
        docs.append((4 * k, " ".join(made.choices(of[lang], k=300) + [late[lang]] * 3), lang))
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    field = language_crf.fit(table)
    for lang, word in late.items():
        assert field.langs[int(field.emissions([word])[0].argmax())] == lang
    text = " ".join(of["aa"][:30] + of["zz"][:20])
    asked = table.unionByName(spark.createDataFrame([(10**6, text, None), (10**6 + 1, "5 6", None), (10**6 + 2, None, None)], table.schema))
    got = {r.doc_id: r for r in language_crf.predicted(asked).where("doc_id >= 1000000").collect()}
    assert (got[10**6].segments, got[10**6].n_words, got[10**6].lang_pred) == ("aa:0:30,zz:30:50", 50, "aa")
    assert all((got[d].segments, got[d].n_words, got[d].lang_pred) == ("", 0, "und") for d in (10**6 + 1, 10**6 + 2))


def test_quality_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    got = [r for r in registry.op10_quality_classifier(spark, sf_dir).collect() if r.held_out and r.doc_id in marks]
    good, poor = ([r.score for r in got if marks[r.doc_id] == k] for k in (1, 0))
    assert good and poor
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in poor]) >= 0.85
    assert np.mean([r.predicted == marks[r.doc_id] for r in got]) >= 0.85


def test_pipeline(spark, sf_dir, rows):
    """All stages but the learned one in plain form; the mix takes whole documents of what is left."""
    poor = {r.doc_id for r in registry.op10_quality_classifier(spark, sf_dir).collect() if r.predicted == 0}
    docs = [r for r in rows if r[0] not in poor]
    drop = plain.dropped_lines(docs)
    cut = []
    for d, text, source, _ in docs:
        lines = (text or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in drop.get(d, ())]
        if left:
            cut.append((d, "\n".join(left) if d in drop else text, source))
    near = plain.near_duplicates(cut)
    one = [r for r in cut if near[r[0]][0] == r[0]]
    items = decontaminate.item_postings(spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    bad = {d for d, _ in plain.leaks(one, items)}
    clean = {d: (text, source) for d, text, source in one if d not in bad}
    assert len(rows) > len(docs) > len(cut) - 1 >= len(one) - 1 and bad

    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "text", "source").collect()
    assert all(clean.get(r.doc_id) == (r.text, r.source) for r in got)
    sizes, taken = Counter(), Counter()
    for text, source in clean.values():
        sizes[source] += plain.size(text)
    for r in got:
        taken[r.source] += plain.size(r.text)
    most = max(plain.size(t) for t, _ in clean.values())
    assert all(abs(taken[s] - x) <= max(0.05 * x, most) for s, x in plain.targets(sizes).items())
    assert max(Counter(r.doc_id for r in got).values()) <= 3
    assert corpus_pipeline.ORACLE_SQL is None
