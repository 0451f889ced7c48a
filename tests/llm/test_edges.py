"""Every operator on nulls, empty and very long texts, repeated rows, extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitesight.llm import decontaminate, jaccard_join, language_crf, lattice_lm, licences, line_dedup, mixing, nearest, pii, quality

GOOD = "One two three four five six seven eight nine ten, said the quiet man of letters."
EXTRA = ["h", "n", "size", "label", "row", "id", "line", "words", "score", "copy", "dropped", "_id"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, GOOD + "\nand a second line that is long enough", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "de", "b"),
        (5, GOOD + "\nand a second line that is long enough", "en", "b"), (5, GOOD + "\nand a second line that is long enough", "en", "b"),
        (None, "null id text of some words here", "fr", None), (6, "x" * 30_000, "en", "a"), (7, "wort und satz " * 4_000, "de", "b"),
        (8, "ß" * 5, "de", None), (9, GOOD.replace("quiet", "quite") + "\nand a second lime that is long enough", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in EXTRA:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 1), (9, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, GOOD), (1, GOOD), (2, None), (3, ""), (4, "wort und satz")], "item_id long, text string").withColumn("score", F.lit(1))


OPERATORS = {
    "mix": lambda d, lab, it: mixing.per_document(d), "corpus": lambda d, lab, it: mixing.mixed_corpus(d),
    "leaks": lambda d, lab, it: decontaminate.contaminated(d, it), "pii": lambda d, lab, it: pii.personal_data(d),
    "lines": lambda d, lab, it: line_dedup.dedup_lines(d), "lm": lambda d, lab, it: lattice_lm.scored(d),
    "language": lambda d, lab, it: language_crf.predicted(d), "licences": lambda d, lab, it: licences.matches(d, licences.known_licences(d.sparkSession)),
    "near": lambda d, lab, it: jaccard_join.near_duplicates(d), "quality": lambda d, lab, it: quality.scored(d, lab),
}
PER_ROW = {"mix", "pii", "lines", "lm", "language", "near", "quality"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows(name, docs, labels, items):
    got = OPERATORS[name](docs, labels, items).collect()
    if name in PER_ROW:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    by = {r["doc_id"]: r for r in got}
    if name == "near":
        assert by[1]["class_id"] == by[5]["class_id"] == 1 and by[5]["n_links"] == 2 and by[2]["class_id"] == 2 and by[2]["n_links"] == 0
    if name == "leaks":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (5, 1), (9, 1), (7, 4)}
    if name == "language":
        assert by[2]["lang_pred"] == by[3]["lang_pred"] == "und" and by[2]["score"] == 0
    if name == "lines":
        assert by[5]["dropped"] == [0, 1] and by[1]["dropped"] == [] and by[9]["dropped"] == [1] and by[2]["n_lines"] == 0
    if name == "lm":
        assert by[2]["n_tokens"] == by[4]["n_tokens"] == 1 and by[7]["n_tokens"] == 12_001
    if name == "mix":
        assert by[2]["taken"] == 0 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(name, docs, labels, items):
    nothing = docs.limit(0)
    assert OPERATORS[name](nothing, labels.limit(0), items).count() == 0
    if name in ("quality", "leaks"):
        assert OPERATORS[name](docs, labels.limit(0), items.limit(0)).count() == (docs.count() if name == "quality" else 0)


def test_vectors(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(45)] + [(0, [0.0, 1.0]), (100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, []), (None, [9.0, 9.0]), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = nearest.nearest(df).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40}
    first = [r for r in got if r["query_id"] == 20]
    assert [r["vec_id"] for r in first][:3] == [2, 5, 8] and 20 not in {r["vec_id"] for r in first} and len(first) == 20
    assert [r["rank"] for r in first] == list(range(1, 21)) and first[0]["score"] == 5.0
    assert nearest.nearest(df.limit(0)).count() == 0


def test_pipeline(spark, docs, tmp_path):
    for name, cols in (("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([(1, 1)] if name == "labels" else [(1, "no such words here at all in any")], cols).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(plain.columns) <= set(got.columns) and 5 not in {r["doc_id"] for r in got.collect()}
