"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 3, the blended
spectrum, presence only) that both have, over the root of the product of their numbers of
n-grams.  Nyström landmarks approximate it: a text's features are its kernels with the
landmarks times the inverse root of the landmarks' own kernel matrix.  One-versus-rest kernel
ridge regression gives a value for each language, and batches of texts are scored by two
matrix products.

The fit uses at most ``sample_per_language`` labelled texts of each language and
``landmarks_per_language`` of those as landmarks: those with the smallest hashes of id and
text.  Scoring covers every text, whole.

A text is foreign to the model when it has far fewer of the landmarks' n-grams, as a share of its own, than any text of the sample:
below ``foreign`` times the least share there.  Only that, or that it has no letters, lets ``keep_identified`` drop a text; a low score
doesn't.  Where nothing could be learned it keeps all texts with letters.

Defined results: ``und`` with score 0 for a null text, a text without letters, and any text
where nothing could be learned; repeated rows are scored each on its own; columns other than
id, text and label are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod_5, fresh, sliced, small_batches

UNKNOWN = "und"
_BITS = 18


@dataclass(frozen=True)
class Settings:
    sample_per_language: int = 400
    landmarks_per_language: int = 32
    ridge: float = 1e-3
    texts_at_once: int = 32
    foreign: float = 0.5  #: of the least share of known n-grams in the sample


def _grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text; those of all sizes share one hash space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
    three = (two[:-1] ^ (c[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
    return (np.concatenate([one, two, three]) >> np.uint64(64 - _BITS)).astype(np.int64)


class Classifier:
    def __init__(self, settings: Settings, texts: list[str], labels: list[str], landmarks: list[bool]):
        self.settings, self.labels = settings, sorted(set(labels))
        chosen = [t for t, is_one in zip(texts, landmarks, strict=True) if is_one]
        found = [np.unique(_grams(t)) for t in chosen]
        self.grams = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        self.place = np.full(1 << _BITS, len(self.grams), np.int64)
        self.place[self.grams] = np.arange(len(self.grams))
        self.matrix = np.zeros((len(self.grams) + 1, len(chosen)), np.float32)
        for i, g in enumerate(found):
            self.matrix[self.place[g], i] = 1 / np.sqrt(len(g))
        self.matrix[-1] = 0
        self.weights = np.zeros((len(chosen), len(self.labels)), np.float32)
        self.least_known = 0.0
        if chosen:
            at = range(0, len(texts), settings.texts_at_once)
            self.least_known = settings.foreign * float(min(self._known(texts[i : i + settings.texts_at_once]).min() for i in at))
            values, vectors = np.linalg.eigh(self._kernels(chosen).astype(np.float64))
            keep = values > 1e-6
            root = vectors[:, keep] / np.sqrt(values[keep])
            x = np.concatenate([self._kernels(texts[i : i + settings.texts_at_once]) for i in range(0, len(texts), settings.texts_at_once)]) @ root
            y = np.where(np.array(labels)[:, None] == np.array(self.labels)[None], 1.0, -1.0)
            share = 1 / np.array([labels.count(t) for t in labels])[:, None]  # languages weigh the same
            ridge = settings.ridge * np.eye(x.shape[1])
            self.weights = (root @ np.linalg.solve(x.T @ (x * share) + ridge, x.T @ (y * share))).astype(np.float32)

    def _present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of the landmarks' n-grams each text has, and how many it has at all."""
        present = np.zeros((len(texts), len(self.grams) + 1), np.float32)
        size = np.ones(len(texts), np.float32)
        for i, t in enumerate(texts):
            seen = np.zeros(1 << _BITS, bool)
            g = _grams(t)
            seen[g] = True
            size[i] = max(1, np.count_nonzero(seen))
            present[i, self.place[g]] = 1
        present[:, -1] = 0
        return present, size

    def _kernels(self, texts: list[str]) -> np.ndarray:
        present, size = self._present(texts)
        return (present @ self.matrix) / np.sqrt(size)[:, None]

    def _known(self, texts: list[str]) -> np.ndarray:
        present, size = self._present(texts)
        return present.sum(1) / size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and the share of each text's n-grams that the landmarks have."""
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        present, size = self._present(texts)
        values = (present @ self.matrix) / np.sqrt(size)[:, None] @ self.weights
        best = values.argmax(1)
        return [self.labels[i] for i in best], np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1).astype(float), (present.sum(1) / size).astype(float)


def fit(docs: DataFrame, settings: Settings = Settings()) -> Classifier:
    """Learns from the rows of ``docs`` (doc_id, text, lang) that have a label and a letter."""
    rank = Window.partitionBy("lang").orderBy("order", "doc_id")
    usable = docs.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    order = F.xxhash64("doc_id", "text")
    # first in 64 parts of each language, so that one with very many texts is no single task's
    part = Window.partitionBy("lang", F.pmod("order", F.lit(64))).orderBy("order", "doc_id")
    parts = usable.select("doc_id", "lang", order.alias("order")).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= settings.sample_per_language)
    first = parts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= settings.sample_per_language)
    # the labels bound the rows here: so many of each
    chosen = usable.withColumn("order", order).join(F.broadcast(first), ["doc_id", "lang", "order"]).select("lang", "rank", "text").dropDuplicates(["lang", "rank"])
    rows = sorted(chosen.collect(), key=lambda r: (r["lang"], r["rank"]))
    return Classifier(settings, [r["text"] for r in rows], [r["lang"] for r in rows], [r["rank"] <= settings.landmarks_per_language for r in rows])


def _predict(shared, added: tuple[str, str, str], letters: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        size = model.settings.texts_at_once
        for b in sliced(batches):
            texts, ok = b["text"].to_pylist(), b[letters].to_numpy(zero_copy_only=False)
            langs, scores, known = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.zeros(len(texts))
            at = np.flatnonzero(ok)
            for i in range(0, len(at), size):
                part = at[i : i + size]
                langs[part], scores[part], known[part] = model.predict([texts[k] for k in part])
            held = [b[n] for n in b.schema.names if n != letters]
            names = [n for n in b.schema.names if n != letters]
            yield pa.record_batch([*held, pa.array(langs, pa.string()), pa.array(scores), pa.array(known)], [*names, *added])

    return run


def predict(docs: DataFrame, model: Classifier, carry: list[str], added: tuple[str, str, str] = ("lang_pred", "score", "known_share")) -> DataFrame:
    """``carry`` columns of every row (``text`` among them), with the predicted language, its score, and the share of known n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that the settings bound
    small_batches(docs.sparkSession)
    given = docs.select(*[F.col(f"`{c}`") for c in carry])
    (letters,) = fresh(given, "__letters")
    schema = given.schema.add(added[0], "string").add(added[1], "double").add(added[2], "double")
    return given.withColumn(letters, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(_predict(shared, added, letters), schema)


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learns where crc32 of the id modulo 5 isn't 0."""
    held_out = crc_mod_5(F.col("doc_id")) == 0
    model = fit(docs.filter(~held_out), settings)
    out = predict(docs.withColumn("held_out", held_out), model, ["doc_id", "text", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "known_share")


def keep_identified(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the languages, with the columns they had."""
    model = fit(docs.filter(crc_mod_5(F.col("doc_id")) != 0), settings)
    if not model.labels:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang, score, known = fresh(docs, "__lang_pred", "__score", "__known")
    out = predict(docs, model, docs.columns, (lang, score, known))
    return out.filter((F.col(lang) != UNKNOWN) & (F.col(known) >= model.least_known)).select(*[F.col(f"`{c}`") for c in docs.columns])
