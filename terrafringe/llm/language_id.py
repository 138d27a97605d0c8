"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrafringe.llm.common import chunks, text_bytes

#: Buckets of each n-gram length; lengths of the n-grams in bytes.
BUCKETS = 1 << 15
LENGTHS = (3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter; numbers such as roman numerals or halves are none."""
    found = _LETTER.search(text or "")
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def codewords(n: int, length: int = 0, tries: int = 200) -> np.ndarray:
    """An n x bits matrix of -1 and 1: all splits of up to 7 languages, else the best spread of `tries` fixed random draws."""
    if n <= 7 and not length:
        bits = max(1, (1 << max(n - 1, 0)) - 1)
        columns = np.arange(bits)
        rows = [np.ones(bits, np.int64)] + [np.where(columns >> (n - 1 - k) & 1, 1, -1) for k in range(1, n)]
        return np.array(rows[:n]).reshape(n, bits)
    bits = length or max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, spread = np.random.default_rng(7), None, -1
    for _ in range(tries):
        code = rng.choice((-1, 1), (n, bits))
        apart = (bits - code @ code.T) // 2 + np.eye(n, dtype=np.int64) * bits
        usable = (np.abs(code.sum(0)) < n).all()
        if usable and apart.min() > spread:
            best, spread = code, int(apart.min())
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of the rows; case is folded, and all that isn't a letter counts as a space."""
    folded = _FOLD[data].astype(np.uint32)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found, rows = [], []
    for k, n in enumerate(LENGTHS):
        m = len(folded) - n + 1
        if m <= 0:
            continue
        value = np.zeros(m, np.uint32)
        for j in range(n):
            value = (value + folded[j : j + m]) * np.uint32(0x9E3779B1)
            value ^= value >> np.uint32(15)
        keep = (row_of[:m] == row_of[n - 1 :]) & ~((folded[:m] == 32) & (folded[1 : m + 1] == 32))
        found.append((value[keep] * np.uint32(0x85EBCA6B) >> np.uint32(17)).astype(np.int64) + k * BUCKETS)
        rows.append(row_of[:m][keep])
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _features(column: pa.Array):
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets, 1 << 19):
        yield a, b, *features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


@dataclass
class Model:
    """Languages, their codewords, the bits' n-gram weights and scales, and how far each bit is trusted for each language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray
    ambiguity: float

    def margins(self, bucket: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Mean weight of each row's n-grams for each bit; zero without n-grams."""
        n = np.bincount(row, minlength=rows)
        sums = np.stack([np.bincount(row, self.weights[:, b][bucket], rows) for b in range(self.code.shape[1])], 1)
        return sums / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by trusted logistic loss, its share of all codewords' exp(-loss), and whether the next is about as near."""
        signed = self.code[None] * (margins * self.scale)[:, None, :]
        loss = (np.logaddexp(0, -signed) * self.trust[None]).sum(2)
        best = loss.argmin(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        ordered = np.sort(loss, 1)
        close = ordered[:, 1] - ordered[:, 0] < self.ambiguity if loss.shape[1] > 1 else np.zeros(len(loss), bool)
        return best, 1 / share.sum(1), close


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, ambiguity: float = 0.05) -> Model:
    """Fit on a sample of about `per_language` documents of each language, taken by a hash of the text.

    The bits' classifiers are linear in the n-grams: the weight is the log
    ratio of the n-gram's mean probability in the languages with bit 1 to that
    in the others, languages counting alike. How often a bit is right for a
    language on the sample is its trust in decoding. At most languages x
    buckets counts come to the driver.
    """
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((len(LENGTHS) * BUCKETS, 1)), np.ones(1), np.zeros((0, 1)), ambiguity)
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / totals[lang]))])
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select(number[F.col("lang")].alias("lang"), "text")
    size = len(LENGTHS) * BUCKETS

    def count(batches):
        counts = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            lang = batch.column(0).to_numpy()
            for a, b, bucket, row in _features(batch.column(1)):
                counts += np.bincount(lang[a:b][row] * size + bucket, minlength=counts.size).reshape(counts.shape)
        for k in range(len(languages)):
            at = np.flatnonzero(counts[k])
            yield pd.DataFrame({"lang": np.int32(k), "bucket": at.astype(np.int32), "n": counts[k][at]})

    def counted(batches):
        for frame in count(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    table = sample.mapInArrow(counted, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), size))
    counts[table["lang"], table["bucket"]] = table["n"]
    smooth = counts + 0.5
    likely = smooth / smooth.sum(1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((size, code.shape[1]))
    for b in range(code.shape[1]):
        up = code[:, b] > 0
        if up.any() and not up.all():
            weights[:, b] = np.log(likely[up].mean(0)) - np.log(likely[~up].mean(0))
    model = Model(languages, code, weights.astype(np.float32), np.ones(code.shape[1]), np.ones(code.shape) / code.shape[1], ambiguity)
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def judged(batches):
        for batch in batches:
            m, lang = sent.value, batch.column(0).to_numpy()
            for a, b, bucket, row in _features(batch.column(1)):
                margins = m.margins(bucket, row, b - a)
                right = margins * m.code[lang[a:b]] > 0
                for k in np.unique(lang[a:b]):
                    own = lang[a:b] == k
                    bits = np.arange(margins.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(bits), k, np.int32), bits, right[own].sum(0), np.abs(margins[own]).sum(0), np.full(len(bits), own.sum()))], names=["lang", "bit", "hits", "size", "n"])

    seen = sample.mapInArrow(judged, "lang int, bit int, hits long, size double, n long").groupBy("lang", "bit").agg(F.sum("hits"), F.sum("size"), F.sum("n")).toPandas()
    hits, sizes, n = (np.ones(code.shape) for _ in range(3))
    for out, column in ((hits, "sum(hits)"), (sizes, "sum(size)"), (n, "sum(n)")):
        out[seen["lang"], seen["bit"]] = seen[column]
    right = np.maximum(hits / n - 0.5, 1e-3)
    model.trust = right / right.sum(1, keepdims=True)
    model.scale = 4 / np.maximum((sizes / n).mean(0), 1e-9)
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1) and ambiguous; the text alone is looked at.

    A null text, or one without a letter, has lang_pred `und` and score 0 and
    is ambiguous, and so has every text if the model knows no language. A model
    of one language names it for all others. Repeated rows are judged alike; no
    shuffle. Columns of `docs` with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    where = docs.columns.index(text_col)

    def run(batches):
        m = sent.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            texts = batch.column(where)
            pred, score, close = np.full(len(texts), len(m.languages)), np.zeros(len(texts)), np.ones(len(texts), bool)
            if m.languages:
                for a, b, bucket, row in _features(texts):
                    pred[a:b], score[a:b], close[a:b] = m.decode(m.margins(bucket, row, b - a))
                blank = np.array([not has_letter(t) for t in texts.to_pylist()], bool)
                pred[blank], score[blank], close[blank] = len(m.languages), 0.0, True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[pred], pa.string()), pa.array(score), pa.array(close)], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
