"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rotated) by its place. A document bundles (adds) the vectors of its n-grams; a
language's prototype bundles its documents. A document gets the language with the largest cosine.

Bundling is linear, so a document's vector is its n-gram counts times the n-gram vectors: one small
matrix product for each piece of a batch. Letters share 127 symbols: a to z have their own, others are
hashed onto the rest. Trigrams whose middle is a letter are used; all else counts as one space.

Prototypes are learned from a bounded sample: at most about PER_LANGUAGE documents of each language,
taken by a hash of the id; counts for that come from all labelled rows. The sum of their vectors is
aggregated by Spark, so the driver gets one vector (8 KB) a language. All labels are learned; the model that
is sent to the tasks takes 4 KB for each, and a document's work grows by as many products.

Defined results: language "und" with score 0 for a null text or one without letters, and for all when no
row has a label; a row without an id is neither learned from nor held out; ties go to the first language in sorted order; whole texts are read, whatever their
length; other columns are ignored; repeated rows are each judged; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, if_few, mix64, slices, small_batches

DIMENSIONS = 1024
SYMBOLS = 128  # 0 is the space
PER_LANGUAGE = 3_000
#: A text of ENOUGH letters that scores less than this is like no language: five deviations of a random cosine.
#: Random letters, base64 and scripts without a prototype score 0.14 at most (200 texts of each kind); known texts
#: of sf0.01 with so many letters 0.18 or above.
KNOWN_SCORE = 5 / DIMENSIONS**0.5
#: With fewer letters a known text scores as low as that by itself, so only those below SHORT_SCORE go.
ENOUGH, SHORT_SCORE = 40, 0.02
#: Bytes of text that are worked on at once.
SLICE = 1 << 18


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point; 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    points = np.array([c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"], dtype=np.uint64)
    out[points.astype(np.int64)] = 27 + mix64(points) % np.uint64(SYMBOLS - 27)
    out[97:123] = np.arange(1, 27)
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=20240229)).choice(np.array([-1, 1], dtype=np.int8), (SYMBOLS, DIMENSIONS))


@lru_cache(maxsize=1)
def _placed() -> list[np.ndarray]:
    """Vectors of the letters at the first, second and third place of a trigram."""
    return [np.roll(_letters(), shift, axis=1) for shift in (2, 1, 0)]


def bundle(counts: np.ndarray, codes: np.ndarray, block: int = 1_024) -> np.ndarray:
    """counts (texts by codes) times the vectors of the trigrams, which are made a block of codes at a time; sums of whole numbers, so exact in any order."""
    first, second, third = _placed()
    out = np.zeros((len(counts), DIMENSIONS), dtype=np.float32)
    for s in range(0, len(codes), block):
        code = codes[s : s + block]
        vectors = first[code // SYMBOLS**2] * second[code // SYMBOLS % SYMBOLS] * third[code % SYMBOLS]
        out += counts[:, s : s + block].astype(np.float32) @ vectors.astype(np.float32)
    return out


def profiles(texts: list[str | None]) -> np.ndarray:
    """Bundled vector of each text; a zero row for a text without letters."""
    return profiles_and_letters(texts)[0]


def profiles_and_letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector of each text, and how many letters it has."""
    joined = "\0" + "\0".join((t or "").replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbol = _symbols()[points]
    doc = np.cumsum(points == 0, dtype=np.int32) - 1
    use = symbol > 0
    use[1:] |= symbol[:-1] > 0  # one space after each word
    use[points == 0] = True  # and one before each text
    symbol, doc = symbol[use].astype(np.int32), doc[use]
    if len(symbol) < 2:
        return np.zeros((len(texts), DIMENSIONS), dtype=np.float32), np.zeros(len(texts), dtype=np.int64)
    before, after = np.r_[np.int32(0), symbol[:-1]], np.r_[symbol[1:], np.int32(0)]
    mid = symbol > 0
    code, doc = (before * SYMBOLS + symbol)[mid] * SYMBOLS + after[mid], doc[mid]
    seen = np.flatnonzero(np.bincount(code, minlength=1))
    place = np.zeros(SYMBOLS**3, dtype=np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    counts = np.bincount(doc.astype(np.int64) * len(seen) + place[code], minlength=len(texts) * len(seen)).reshape(len(texts), len(seen))
    return bundle(counts, seen), counts.sum(1)


def train_row(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and their prototypes, from rows of train_row with a label."""
    small_batches(docs.sparkSession)
    rows = docs.where(train_row(id_col) & F.col(lang_col).isNotNull())
    # one row a label
    sizes = Scratch(docs.sparkSession, "languages").save(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n_")), "sizes")
    share = F.least(F.lit(1_000_000), F.floor(F.lit(1_000_000.0) * per_language / F.col("n_")) + 1)
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1_000_000)).alias("u_")
    taken = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), u).join(if_few(sizes), "lang").where(F.col("u_") < share)

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(b, "text", SLICE):
                vectors, langs = profiles(part.column(0).to_pylist()), np.array(part.column(1).to_pylist(), dtype=object)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors = vectors / np.maximum(norms, 1e-9)
                for lang in set(langs):
                    sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(np.round(v * 1e6).astype(np.int64))], ["lang", "place", "value"])

    parts = taken.select("text", "lang").mapInArrow(bundle, "lang string, place int, value long")
    total = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).toArrow()  # languages times dimensions
    langs = sorted(total["lang"].unique().to_pylist())
    wide = np.zeros((len(langs), DIMENSIONS), dtype=np.float64)
    row = pa.compute.index_in(total["lang"], pa.array(langs, total["lang"].type)).to_numpy()
    wide[row, total["place"].to_numpy()] = total["value"].to_numpy()
    keep = np.linalg.norm(wide, axis=1) > 0
    return [x for x, k in zip(langs, keep) if k], wide[keep]


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table's columns, then lang_pred, score, letters."""
    units = (prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    names = np.array([*langs, "und"], dtype=object)

    @F.pandas_udf("lang_pred string, score double, letters long")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            yield judged(text)

    def judged(text: pd.Series) -> pd.DataFrame:
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.string())], ["text"])
        best, score, letters = [], [], []
        for part in slices(batch, "text", SLICE):
            vectors, n = profiles_and_letters(part.column(0).to_pylist())
            letters.append(n)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = np.c_[(vectors @ units.T) / np.maximum(norms, 1e-9)[:, None], np.full(len(vectors), -2.0)]
            at = np.where(norms > 0, cosines.argmax(1), len(langs))
            best.append(at)
            score.append(np.where(at < len(langs), np.clip(cosines[np.arange(len(at)), at], 0, 1), 0.0))
        return pd.DataFrame({"lang_pred": names[np.concatenate([[], *best]).astype(int)], "score": np.concatenate([[], *score]), "letters": np.concatenate([[], *letters]).astype(np.int64)})

    return docs.withColumn("judged_", judge(F.col(text_col))).select(*(F.col(c) for c in docs.columns), "judged_.lang_pred", "judged_.score", "judged_.letters")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    langs, prototypes = learn(docs)
    rows = docs.select("doc_id", "text", F.coalesce(~train_row(), F.lit(False)).alias("held_out"))
    return predict(rows, langs, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, text_col: str = "text", min_score: float = KNOWN_SCORE) -> DataFrame:
    """Rows whose language is known: texts without letters, and those like no language, go. ENOUGH letters are needed to tell."""
    langs, prototypes = learn(docs, text_col=text_col)
    if not langs:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("original"), F.col(text_col).alias("text"))
    least = F.when(F.col("letters") >= ENOUGH, F.lit(min_score)).otherwise(F.lit(min(min_score, SHORT_SCORE)))
    return predict(rows, langs, prototypes).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("original.*")
