"""Language identification by nearest centroid.

A text's vector holds the normalised TF-IDF of its byte n-grams (1 to 3, hashed into ``dims``
places), with letters in lower case and all that is no letter as one blank. Each language has
several centroids, from spherical k-means over its training vectors; the prediction is the language
of the centroid with the largest cosine. A text is marked as rejected if its cosine is below half of
what nearly all training texts of its length have to centroids that were learned without them.

Bounds: training takes at most ``per_language`` texts a language, those with the smallest hash of
doc_id, and fewer of each where there are so many languages that this were more than ``most_texts``;
both are parameters, and every language is learned. All else covers all rows. The model is
``(languages x centroids) x dims`` floats.

Cases: a text that is null or without a letter is `und` with score 0 and rejected; null lang never
trains; without any training row everything is `und`; ties go to the language first in order;
repeated rows and doc_ids are scored each; an empty table gives an empty table; further columns of
the input are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .words import slices

#: What each byte becomes: letters of ASCII in lower case, bytes of longer characters as they are, all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: Upper-case Latin letters of two bytes that start with 0xC3, so that their second byte is in lower case too.
_LETTER = r"\p{L}"


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # (languages * per language) x dims
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    floors: np.ndarray  # least cosine that is accepted, by length class
    dims: int


def _length_class(n_grams: int) -> int:
    return min(15, int(n_grams).bit_length())


def gram_places(octets: np.ndarray, dims: int) -> np.ndarray:
    """Hashed places of the 1- to 3-grams of folded bytes; runs of blanks count as one."""
    folded = _FOLD[octets]
    if len(folded) > 1:
        upper = (folded[:-1] == 0xC3) & (folded[1:] >= 0x80) & (folded[1:] <= 0x9E)
        folded[1:][upper] += 0x20
        keep = np.ones(len(folded), bool)
        keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
        folded = folded[keep]
    x = folded.astype(np.uint32)
    grams = [x]
    if len(x) > 1:
        grams.append((x[:-1] << np.uint32(8)) | x[1:] | np.uint32(1 << 25))
    if len(x) > 2:
        grams.append((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:] | np.uint32(1 << 26))
    return ((np.concatenate(grams) * np.uint32(0x9E3779B1)) >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    norm = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.maximum(norm, np.float32(1e-12))


def _counts(batch: pa.RecordBatch, column: int, dims: int, at_once: int = 128):
    """(first row, counts of rows x dims) for a few rows at a time."""
    at = 0
    for part, octets, offsets in slices(batch, column):
        for i in range(0, part.num_rows, at_once):
            own = offsets[i : i + at_once + 1]
            yield at + i, np.stack([np.bincount(gram_places(octets[a:b], dims), minlength=dims) if b > a else np.zeros(dims, np.int64) for a, b in zip(own[:-1], own[1:], strict=True)]).astype(np.float32)
        at += part.num_rows


def _cluster(v: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    k = min(k, len(v))
    centres = v[rng.choice(len(v), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(v @ centres.T, axis=1)
        sums = np.stack([v[near == j].sum(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def _left_out(v: np.ndarray, langs: np.ndarray, folds: np.ndarray, centroids: int, seed: int) -> np.ndarray:
    """Each text's largest cosine to centroids of the texts of other folds. Equal texts share a fold."""
    best = np.zeros(len(v), np.float32)
    for fold in np.unique(folds):
        own = folds == fold
        # A single fold has no others: its own centroids must do.
        rest = ~own if not own.all() else own
        groups = [_cluster(v[rest & (langs == k)], centroids, seed + int(k)) for k in np.unique(langs[rest])]
        best[own] = (v[own] @ np.concatenate(groups).T).max(axis=1)
    return best


def _floors(best: np.ndarray, classes: np.ndarray, share: float, quantile: float = 0.01, least: int = 20) -> np.ndarray:
    """``share`` of a low quantile of each length class, pooled with its neighbours up to ``least`` texts; the lowest text never sets it alone."""
    floors = np.zeros(16, np.float32)
    for k in range(16 if len(best) else 0):
        for around in range(16):
            own = np.sort(best[np.abs(classes - k) <= around])
            if len(own) >= least:
                break
        floors[k] = share * own[min(len(own) - 1, 1 + int(quantile * len(own)))]
    return floors


def training_texts(train: DataFrame, per_language: int, most_texts: int, seed: int) -> DataFrame:
    """(lang, text) of the bounded sample. Keys are chosen first, so the only texts that move are those of the sample; rows that repeat count once."""
    known = train.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(_LETTER))
    keys = known.select("lang", "doc_id", F.xxhash64("text").alias("_text")).distinct()
    languages = known.select("lang").distinct().count()
    most = max(4, min(per_language, most_texts // max(1, languages)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id"), F.lit(seed)), "doc_id", "_text")
    chosen = keys.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= most)
    chosen = shared.materialize(chosen.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), "_text"), "sample")
    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))
    found = known.select("lang", "doc_id", "text").join(F.broadcast(chosen), same)
    return found.groupBy("lang", "doc_id", "_text").agg(F.first("text").alias("text")).select("lang", "text")


def fit(train: DataFrame, per_language: int = 300, most_texts: int = 60_000, centroids: int = 4, dims: int = 8192, seed: int = 7, floor_share: float = 0.5) -> Model:
    """Learn from ``train`` (doc_id, text, lang). What reaches the driver is sparse counts of the bounded sample."""
    sample = training_texts(train, per_language, most_texts, seed)

    def count(batches):
        shared.own_worker("language")
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, counts in _counts(batch, 1, dims):
                places = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs[first : first + len(counts)]), pa.array([p.astype(np.uint16).tobytes() for p in places]), pa.array([np.minimum(c[p], 65535).astype(np.uint16).tobytes() for c, p in zip(counts, places, strict=True)])],
                    names=["lang", "places", "counts"],
                )

    rows = sample.mapInArrow(count, "lang string, places binary, counts binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.places), bytes(r.counts)))
    counts = np.zeros((len(rows), dims), np.float32)
    for c, r in zip(counts, rows, strict=True):
        c[np.frombuffer(r.places, np.uint16)] = np.frombuffer(r.counts, np.uint16)
    names = sorted({r.lang for r in rows})
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    v = _vectors(counts, idf)
    number = {x: k for k, x in enumerate(names)}
    langs = np.array([number[r.lang] for r in rows], np.int64)
    groups = [_cluster(v[langs == k], centroids, seed + k) for k in range(len(names))]
    owner = np.repeat(np.arange(len(names)), [len(g) for g in groups]) if groups else np.zeros(0, np.int64)
    centres = np.concatenate(groups) if groups else np.zeros((0, dims), np.float32)
    folds = np.array([zlib.crc32(bytes(r.places) + bytes(r.counts)) % 4 for r in rows], np.int64)
    classes = np.array([_length_class(c.sum()) for c in counts], np.int64)
    floors = _floors(_left_out(v, langs, folds, centroids, seed), classes, floor_share)
    return Model(names, centres, owner, idf, floors, dims)


def predict(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected, and the ``carry`` columns, of each row of ``docs`` (doc_id, text). No shuffle."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    inside = [shared.column(c).alias(f"_carry_{i}") for i, c in enumerate(carry or [])]
    # A text that is carried is scored where it is carried; it goes to Python once.
    own = [] if "text" in (carry or []) else [F.col("text").alias("_text")]
    rows = docs.select("doc_id", *inside, *own, F.coalesce(F.col("text"), F.lit("")).rlike(_LETTER).alias("_letters"))
    fields = [f for f in rows.schema.fields if f.name not in ("_letters", "_text")]
    at = 1 + (carry or []).index("text") if not own else len(fields)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def score(batches):
        shared.own_worker("language")
        m = held.value
        for batch in batches:
            letters = batch.column(batch.num_columns - 1).to_pylist()
            names, scores, rejected = [], [], []
            for first, counts in _counts(batch, at, m.dims):
                if not len(m.languages):
                    names += ["und"] * len(counts)
                    scores += [0.0] * len(counts)
                    rejected += [True] * len(counts)
                    continue
                near = _vectors(counts, m.idf) @ m.centroids.T
                best = near.argmax(axis=1)
                for k, (j, c) in enumerate(zip(best.tolist(), counts, strict=True)):
                    cosine = float(min(1.0, max(0.0, near[k, j])))
                    ok = letters[first + k]
                    names.append(m.languages[m.owner[j]] if ok else "und")
                    scores.append(cosine if ok else 0.0)
                    rejected.append(not ok or cosine < m.floors[_length_class(c.sum())])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(fields))), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*(f.name for f in fields), "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(score, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select("doc_id", *(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry or [])), "lang_pred", "score", "rejected")


def held_out(docs: DataFrame):
    return F.coalesce(shared.doc_hash(4) == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    model = fit(docs.where(~held_out(docs)))
    return predict(docs, model).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score", "rejected")
