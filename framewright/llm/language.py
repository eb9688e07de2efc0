"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, the same on every machine.  An n-gram is bound
as the product of its letters' vectors, each rotated by its place; a text bundles the
vectors of all its n-grams, and a language bundles the texts it is learnt from.  A text
belongs to the language whose prototype it has the largest cosine with.

Learning takes at most ``max_rows`` documents, those with the smallest hash of their id;
per language one sum of ``dim`` numbers reaches the driver.  Prediction reads whole texts.

Texts that are null or have no letter are ``und`` with score 0, and so is everything when
there is nothing to learn from.  Ties go to the language that sorts first.  Repeated rows
repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import bound_text_batches, give_back, tidy

MAX_ROWS = 12_000
DIM = 512
SIZE = 3
UNKNOWN = "und"
# Bound n-gram vectors that a worker keeps.
KEPT = 10_000


class Encoder:
    """Texts to bundled vectors."""

    def __init__(self, dim: int = DIM, size: int = SIZE, seed: int = 9):
        self.dim, self.size, self.seed = dim, size, seed
        self.letters: dict[int, np.ndarray] = {}
        self.codes = np.empty(0, np.uint64)
        self.bound = np.empty((0, dim), np.float32)

    def letter(self, point: int) -> np.ndarray:
        """Random signs of one letter; 0 stands for what is between words."""
        v = self.letters.get(point)
        if v is None:
            if len(self.letters) > 20_000:
                self.letters.clear()
            v = np.random.default_rng((self.seed, point)).integers(0, 2, self.dim).astype(np.float32) * 2 - 1
            self.letters[point] = v
        return v

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the n-grams of letters; words are set apart by one gap."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        is_letter = _is_letter(points)
        if not is_letter.any():
            return np.empty(0, np.uint64), np.empty(0)
        s = np.where(is_letter, points, 0).astype(np.uint64)
        keep = is_letter | np.concatenate(([True], is_letter[:-1]))
        s = np.concatenate(([0], s[keep], [0])).astype(np.uint64)
        code = np.zeros(max(0, len(s) - self.size + 1), np.uint64)
        for k in range(self.size):
            code = code << np.uint64(21) | s[k:len(s) - self.size + 1 + k]
        codes, counts = np.unique(code, return_counts=True)
        return codes, counts

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Places of the bound vectors of ``codes``, which are made where they are new."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        new = codes[~known]
        if len(new):
            fresh = np.ones((len(new), self.dim), np.float32)
            for k in range(self.size):
                points = (new >> np.uint64(21 * (self.size - 1 - k)) & np.uint64((1 << 21) - 1)).astype(np.int64)
                kinds, inverse = np.unique(points, return_inverse=True)
                fresh *= np.stack([np.roll(self.letter(int(p)), self.size - 1 - k) for p in kinds])[inverse]
            if len(self.codes) + len(new) > KEPT:
                keep = np.isin(self.codes, codes)
                self.codes, self.bound = self.codes[keep], self.bound[keep]
            both = np.concatenate((self.codes, new))
            order = np.argsort(both, kind="stable")
            self.codes, self.bound = both[order], np.concatenate((self.bound, fresh))[order]
            at = np.searchsorted(self.codes, codes)
        return at

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of texts, and which of them have a letter."""
        found = [self.grams(t) for t in texts]
        heard = np.array([len(c) > 0 for c, _ in found], bool)
        out = np.zeros((len(texts), self.dim))
        for a in range(0, len(texts), 32):
            part = found[a:a + 32]
            codes = np.unique(np.concatenate([c for c, _ in part])) if part else np.empty(0, np.uint64)
            if not len(codes):
                continue
            at = self.rows(codes)
            table = self.bound[at]
            weight = np.zeros((len(part), len(codes)), np.float32)
            for i, (c, n) in enumerate(part):
                weight[i, np.searchsorted(codes, c)] = n
            out[a:a + 32] = weight @ table
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1), heard


def _is_letter(points: np.ndarray) -> np.ndarray:
    """Letters of the basic scripts by table, others by asking for each kind."""
    kinds, inverse = np.unique(points, return_inverse=True)
    return np.array([chr(p).isalpha() if p < 0xD800 or 0xDFFF < p < 0x110000 else False for p in kinds.tolist()], bool)[inverse] \
        if len(kinds) else np.zeros(0, bool)


@dataclass
class Profiles:
    """Prototypes, one unit row per language, in the order of names."""

    names: list[str]
    rows: np.ndarray
    dim: int = DIM
    size: int = SIZE
    seed: int = 9

    def predict(self, encoder: Encoder, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, heard = encoder.encode(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = x @ self.rows.T
        best = cosine.argmax(axis=1)
        score = np.where(heard, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.names[b] if h else UNKNOWN for b, h in zip(best, heard)], score


def _bundles(dim: int, size: int, seed: int):
    def kernel(batches):
        encoder, sums = Encoder(dim, size, seed), {}
        for batch in batches:
            x, heard = encoder.encode(batch.column(1).to_pylist())
            for lang, v, h in zip(batch.column(0).to_pylist(), x, heard):
                if h:
                    sums[lang] = sums.get(lang, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()],
                                          pa.list_(pa.float64()))], ["lang", "v"])
    return kernel


def train(docs: DataFrame, usable: Column, max_rows: int = MAX_ROWS, dim: int = DIM, size: int = SIZE, seed: int = 9,
          key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes from rows with a language for which ``usable`` holds."""
    bound_text_batches(docs.sparkSession)
    ids = docs.where(usable & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows).distinct()
    source = docs.where(usable & F.col(lang).isNotNull()).select(
        F.col(key).cast("long").alias("_id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sample = source.join(F.broadcast(ids), "_id").select("lang", "text")
    sums = sample.mapInArrow(tidy(_bundles(dim, size, seed)), "lang string, v array<double>")
    total = sums.select("lang", F.posexplode("v").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in total.collect():  # languages x dim numbers
        found.setdefault(r["lang"], np.zeros(dim))[r["at"]] = r["v"]
    names = sorted(found)
    rows = np.stack([found[n] / max(np.linalg.norm(found[n]), 1e-12) for n in names]) if names else np.empty((0, dim))
    return Profiles(names, np.round(rows, 9), dim, size, seed)


def _predictions(profiles: Profiles):
    def kernel(batches):
        encoder = Encoder(profiles.dim, profiles.size, profiles.seed)
        for batch in batches:
            lang, score = profiles.predict(encoder, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])
    return kernel


def identify(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) per row."""
    bound_text_batches(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(_predictions(profiles)), "key long, lang_pred string, score double").withColumnRenamed("key", key)


def with_language(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with a column ``lang_found`` (language, score) beside its own columns."""
    bound_text_batches(docs.sparkSession)
    kind = "struct<lang_pred:string,score:double>"

    def predict(parts):
        import pandas as pd
        encoder = Encoder(profiles.dim, profiles.size, profiles.seed)
        for texts in parts:
            lang, score = profiles.predict(encoder, texts.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        give_back()
    # A filter on the result would otherwise be pushed below it and predict once more.
    udf = F.pandas_udf(predict, kind, F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    return docs.withColumn("lang_found", udf(F.col(text).cast("string")))
