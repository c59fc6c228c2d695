"""Language ID by bit-sliced Bloom filters of n-grams.

One Bloom filter a language, sliced by bit: slot i of the table holds a word whose bit l is bit i of language l's filter.
ANDing the words of an n-gram's HASHES slots gives all languages that contain it, at once. A text's n-grams are counted
for each language (a popcount by bit); a language's share of them is corrected for its filter's rate of false positives,
and the largest share decides.

A filter holds the n-grams that occur in at least MIN_RATE of a language's sampled documents and not much more often in
another language. A sample of d distinct n-grams a document has at most d / MIN_RATE such n-grams, however large it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from arborq.llm.common import slices, table, texts_of

#: Bytes of an n-gram (of UTF-8 text, lower-cased, blanks for ASCII other than letters), log2 of the slots, hashes.
GRAM, SLOT_BITS, HASHES = 4, 19, 3
#: Labelled documents of each language that filters are made from, at most.
TRAIN_DOCS = 1500
MIN_RATE, MIN_SHARE = 0.02, 0.25
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of all texts one after another as uint32, how many each has): of " words between blanks "."""
    parts = [b" ".join(t.lower().encode().translate(_BLANK).split()) for t in texts]
    data = np.frombuffer(b"".join(b" %b   " % p for p in parts) + bytes(GRAM), np.uint8).astype(np.uint32)
    sizes = np.array([len(p) + 4 for p in parts], np.int64)  # a blank before, three after
    n = int(sizes.sum())
    codes = data[:n] | data[1 : n + 1] << np.uint32(8) | data[2 : n + 2] << np.uint32(16) | data[3 : n + 3] << np.uint32(24)
    keep = np.ones(n, bool)
    ends = np.cumsum(sizes)
    for k in (1, 2, 3):  # those that begin in the blanks after a text
        keep[ends - k] = False
    return codes[keep], sizes - 3


def slots_of(codes: np.ndarray, k: int) -> np.ndarray:
    mixed = codes * np.uint32(_FACTORS[k])
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(_FACTORS[(k + 1) % len(_FACTORS)])
    return mixed >> np.uint32(32 - SLOT_BITS)


@dataclass
class Filters:
    langs: list[str]
    words: np.ndarray  #: (slots, 64-bit words), or 8-bit words for up to 8 languages
    false_rates: np.ndarray

    @classmethod
    def build(cls, langs: list[str], codes: np.ndarray, masks: list[np.ndarray]) -> Filters:
        """masks: for each language, which codes it has."""
        kind, width = (np.uint8, 8) if len(langs) <= 8 else (np.uint64, 64)
        words = np.zeros((1 << SLOT_BITS, -(-max(1, len(langs)) // width)), kind)
        for i, has in enumerate(masks):
            for k in range(HASHES):
                words[slots_of(codes[has], k), i // width] |= kind(1 << i % width)
        fill = [np.count_nonzero(words[:, i // width] >> kind(i % width) & kind(1)) / len(words) for i in range(len(langs))]
        return cls(langs, words, np.array(fill) ** HASHES)

    def shares(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): the share of a text's n-grams that a language has, corrected for false positives."""
        codes, sizes = grams_of(texts)
        width, kind = self.words.itemsize * 8, self.words.dtype.type
        at = np.append(0, np.cumsum(sizes)[:-1])
        hits = np.empty((len(texts), len(self.langs)))
        slots = [slots_of(codes, k) for k in range(HASHES)]
        for w in range(self.words.shape[1]):
            column = np.ascontiguousarray(self.words[:, w])
            found = column.take(slots[0])
            for s in slots[1:]:
                found &= column.take(s)
            for i in range(w * width, min(len(self.langs), (w + 1) * width)):
                hits[:, i] = np.add.reduceat(found >> kind(i % width) & kind(1), at, dtype=np.int64) if len(texts) else 0
        share = hits / sizes[:, None]
        return np.clip((share - self.false_rates) / np.maximum(1e-9, 1 - self.false_rates), 0, 1)

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        shares = self.shares(texts)
        best = shares.argmax(1)
        known = [bool(_LETTER.search(t)) for t in texts]
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], [s if k else 0.0 for s, k in zip(shares.max(1).tolist(), known, strict=True)]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): in how many of a partition's documents an n-gram occurs."""
    found: dict[str, list[np.ndarray]] = {}
    for batch in slices(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
            found.setdefault(lang, []).append(np.unique(grams_of([text])[0]))
    for lang, grams in found.items():
        codes, counts = np.unique(np.concatenate(grams), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def train(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from at most docs_per_lang labelled rows of each language, those with the least hashes of their ids. Rows with a null language are left out. No labelled row: filters of no language."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Filters.build([], np.zeros(0, np.uint32), [])
    order = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000_000))
    likely = F.lit(False)
    for lang, n in counts.items():
        likely = likely | ((F.col("lang") == lang) & (F.col("order") < int(1e9 * min(1, 2 * docs_per_lang / n))))
    rows = rows.withColumn("order", order).where(likely)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "text"))).where(F.col("place") <= docs_per_lang)
    grams = rows.select("lang", "text").mapInArrow(_document_counts, "lang string, gram long, n long")
    sizes = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(float(min(n, docs_per_lang))))])
    rates = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rate", F.col("n") / sizes[F.col("lang")]).where(F.col("rate") >= MIN_RATE)
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("of"))
    kept = best.select("gram", F.transform(F.filter("of", lambda x: x["rate"] >= MIN_SHARE * F.col("best")), lambda x: x["lang"]).alias("langs")).collect()
    codes = np.array([r["gram"] for r in kept], np.uint32)
    return Filters.build(langs, codes, [np.array([lang in r["langs"] for r in kept], bool) for lang in langs])


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs' own columns with lang_pred and score (0 to 1) added, replacing columns of those names.

    Reads whole texts only. A null text, or one without a letter, is UNKNOWN with score 0; so is every text if the filters
    know no language. Of languages with equal shares the first in alphabetical order is taken.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size is fixed by SLOT_BITS and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            langs, scores = shared.value.decide(texts_of(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that the query's filters don't learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), filters).drop("text")
