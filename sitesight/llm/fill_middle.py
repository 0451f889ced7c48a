"""Fill-in-the-middle documents: a text cut at two units and written with its middle last.

A unit is a run of Latin letters or one other character. Texts are cut into fixed blocks of code
points; a Fenwick tree over a text's blocks holds how many units start in each and how many code
points it has. A binary-lifting descent finds the block in which a cut's unit starts, and only that
block is searched for the place. Counting goes piece by piece, many short texts at once, so memory
beyond the texts themselves does not grow with a text's length.

Cuts and form depend on the id alone (``seed:doc_id`` hashed by SHA-256), so reruns agree.

Defined results: a null text counts as empty; empty texts and texts that hold a marker stay plain;
a null id hashes the seed and the colon alone; repeated rows and ids each give their row; extra
columns are ignored; an empty table gives no rows. A cut may fall on either end of the text, and the
middle is empty if both cuts are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a block, of a piece that is counted at once, and of texts that are held as one output batch.
BLOCK, PIECE, HELD = 4096, 1 << 20, 1 << 23


class Fenwick:
    """Prefix sums over blocks of (units that start there, code points)."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.tree = np.zeros((self.size + 1, 2), np.int64)
        self.tree[1:] = counts
        for i in range(1, self.size + 1):
            up = i + (i & -i)
            if up <= self.size:
                self.tree[up] += self.tree[i]

    def total(self) -> tuple[int, int]:
        units = points = 0
        i = self.size
        while i:
            units, points, i = units + int(self.tree[i, 0]), points + int(self.tree[i, 1]), i & (i - 1)
        return units, points

    def descend(self, unit: int) -> tuple[int, int]:
        """Units and code points of the longest run of first blocks in which at most ``unit`` units start."""
        at, units, points = 0, 0, 0
        step = 1 << self.size.bit_length()
        while step:
            if at + step <= self.size and units + self.tree[at + step, 0] <= unit:
                at += step
                units, points = units + int(self.tree[at, 0]), points + int(self.tree[at, 1])
            step >>= 1
        return units, points


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters(codes: np.ndarray) -> np.ndarray:
    return ((codes | 32) - np.uint32(97)) < 26


def _starts(letter: np.ndarray, first: np.ndarray, carried: np.ndarray) -> np.ndarray:
    """Where a unit starts; ``carried`` says whether a letter comes before each place in ``first``."""
    before = np.empty_like(letter)
    before[1:] = letter[:-1]
    before[first] = carried
    return ~(letter & before)


def _is_letter(text: str, at: int) -> bool:
    return at >= 0 and text[at].isascii() and text[at].isalpha()


def block_counts(texts: list[str]) -> list[np.ndarray]:
    """For each text, (units that start, code points) of each of its blocks."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    parts: list[tuple[int, str, bool]] = []
    held = 0

    def count() -> None:
        sizes = np.array([len(p) for _, p, _ in parts])
        first = np.cumsum(sizes) - sizes
        letter = _letters(_codes("".join(p for _, p, _ in parts)))
        start = _starts(letter, first, np.array([c for _, _, c in parts]))
        blocks = -(-sizes // BLOCK)
        lows = np.repeat(first, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        units = np.add.reduceat(start, lows, dtype=np.int64)
        points = np.diff(np.append(lows, len(letter)))
        both = np.stack([units, points], axis=1)
        for (k, _, _), low, n in zip(parts, np.cumsum(blocks) - blocks, blocks):
            out[k].append(both[low: low + n])
        parts.clear()

    for k, text in enumerate(texts):
        for low in range(0, len(text), PIECE):
            piece = text[low: low + PIECE]
            parts.append((k, piece, _is_letter(text, low - 1)))
            held += len(piece)
            if held >= PIECE:
                count()
                held = 0
    if parts:
        count()
    return [np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in out]


def boundary(text: str, tree: Fenwick, unit: int) -> int:
    """The code point at which unit number ``unit`` (from 0) starts; the text's end if there is none."""
    units, low = tree.descend(unit)
    if low >= len(text):
        return len(text)
    letter = _letters(_codes(text[low: low + BLOCK]))
    start = _starts(letter, np.array([0]), np.array([_is_letter(text, low - 1)]))
    return low + int(np.flatnonzero(start)[unit - units])


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()),
])


def _rearranged(plain_from: int, spm_below: int):
    def rearrange(doc_id, text: str, counts: np.ndarray, h1: int, h2: int, h3: int, h4: int) -> tuple:
        tree = Fenwick(counts)
        n, _ = tree.total()
        if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain_from:
            return doc_id, n, "plain", None, None, text
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        low, high = boundary(text, tree, a), boundary(text, tree, b)
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        if h4 % 100 < spm_below:
            form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
        else:
            form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
        return doc_id, n, form, low, high - low, "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, texts = [], 0, batch.column(1)
            for i in range(batch.num_rows):
                rows.append((batch.column(0)[i].as_py(), texts[i].as_py(), *(batch.column(c)[i].as_py() for c in range(2, 6))))
                held += len(rows[-1][1])
                if held >= HELD or i == batch.num_rows - 1:
                    done = [rearrange(r[0], r[1], c, *r[2:]) for r, c in zip(rows, block_counts([r[1] for r in rows]))]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), _SCHEMA)], schema=_SCHEMA)
                    rows, held = [], 0

    return run


def filled(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of ``docs`` (doc_id, text).

    Of a hundred documents ``plain_from`` are cut, and of a hundred cut ones ``spm_below`` have the
    suffix first (``spm``), the others the prefix (``psm``).
    """
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    group = [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *group)
    return rows.mapInArrow(_rearranged(plain_from, spm_below), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``filled``) with ``text``, rebuilt from ``form`` and ``output`` alone.

    A cut text holds no marker, and a marker begins with ``<`` and ends with ``>`` only, so each stands
    in the output once.
    """

    def before(text, mark):
        return F.substring_index(text, mark, 1)

    def after(text, mark):
        return F.substring_index(text, mark, -1)

    out, skip = F.col("output"), F.lit(len(PREFIX) + 1)
    middle = after(out, MIDDLE)
    first = {"psm": before(out, SUFFIX), "spm": before(out, PREFIX)}
    first = {form: F.substr(x, skip) for form, x in first.items()}
    second = {"psm": before(after(out, SUFFIX), MIDDLE), "spm": before(after(out, PREFIX), MIDDLE)}
    text = (
        F.when(F.col("form") == "psm", F.concat(first["psm"], middle, second["psm"]))
        .when(F.col("form") == "spm", F.concat(second["spm"], middle, first["spm"]))
        .otherwise(out)
    )
    return rows.withColumn("text", text)


def digests(docs: DataFrame) -> DataFrame:
    """``filled`` with SHA-256 digests in place of the texts: of the output and of the text rebuilt from it."""
    return restored(filled(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256")
    )


def duckdb_sql() -> str:
    return """
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, x, u, CAST(len(u) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM units
), cut AS (
    SELECT doc_id, x, n,
           CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
           array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
           array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM cut
"""
