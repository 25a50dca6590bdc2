"""Operator 5: language identification, family first, then within the family.

Linear support vector machines over frequencies of letter trigrams (hashed to
``DIMS`` features): one-versus-one machines between language families choose
the family, one-versus-one machines between the languages of that family
choose the language. Every prediction looks at the whole text and at nothing
else. Its score is the product of the two choices' probabilities of being
right, by logistic curves fitted on whole texts of a quarter of the sample
that machines of the other three quarters have not seen.

The machines are fitted on a bounded sample of labelled rows: at most
``MAX_SAMPLE`` rows, shared evenly between the languages and picked by a hash
of the id. Their trigram counts are computed by Spark; only the sample's
sparse vectors (some kilobytes each) come to the driver. Prediction is one
narrow pass over the documents: no shuffle, a model of some hundred kilobytes
in the task closure, and text handled a few megabytes at a time.

Cases: a null text, or one without a letter, is ``und`` with score 0; without
labelled rows everything is ``und``; null labels are not learned from; a null
id counts as not held out; repeated rows are predicted alike; other columns
are kept whatever their names (``lang_pred``, ``score`` and ``held_out``
replace columns of those names).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skywatch.llm.common import fresh, release, table

UNDETERMINED = "und"
DIMS_BITS = 15
DIMS = 1 << DIMS_BITS
MAX_SAMPLE = 8000
STEP_BYTES = 4 << 20
HELD_OUT = 4  # one in so many rows of the sample calibrates, and so many at least
HELD_OUT_LEAST = 20
SCALE = 12.0  # frequencies are small; this brings vectors to about unit length

# Languages by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb".split(), "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(), "uralic": "fi et hu".split(), "baltic": "lt lv".split(),
    "indic": "hi bn mr ne pa gu ur".split(), "turkic": "tr az kk uz ky".split(), "semitic": "ar he mt am".split(),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_LETTER = re.compile(r"[^\W\d_]")
# ASCII other than letters is a space, upper case is lower case; other bytes stay (texts are lower-cased before).
_CLEAN = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], f"only {lang}")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def _steps(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, features of their trigrams one row after the other, where each row starts) by some megabytes
    of text; rows without a letter do not appear."""
    rows, parts, size = [], [], 0
    for i in range(len(texts) + 1):
        if rows and (i == len(texts) or size >= STEP_BYTES):
            data = np.frombuffer(b" " + b"".join(parts) + b" ", np.uint8)
            keep = data[1:-1] != 32  # a trigram around each letter
            code = data[:-2].astype(np.uint32)
            code |= data[1:-1].astype(np.uint32) << np.uint32(8)
            code |= data[2:].astype(np.uint32) << np.uint32(16)
            code *= np.uint32(2654435761)
            code >>= np.uint32(32 - DIMS_BITS)
            ends = np.cumsum([len(p) for p in parts])
            counts = np.diff(np.concatenate(([0], np.cumsum(keep)[ends - 1])))
            yield np.array(rows), code[keep].astype(np.int32), np.concatenate(([0], np.cumsum(counts)[:-1]))
            rows, parts, size = [], [], 0
        if i < len(texts) and texts[i] and _LETTER.search(texts[i]):
            rows.append(i)
            parts.append(texts[i].lower().encode("utf-8", "replace").translate(_CLEAN) + b" ")
            size += len(parts[-1])
            if parts[-1].isspace():
                rows.pop(), parts.pop()


def _vectors(texts: list) -> list:
    """A text's features as bytes (feature uint16, count uint32 arrays), None without a letter."""
    out = [None] * len(texts)
    for rows, code, starts in _steps(texts):
        ends = np.append(starts[1:], len(code))
        for r, a, b in zip(rows, starts, ends, strict=True):
            at, n = np.unique(code[a:b], return_counts=True)
            out[r] = at.astype("<u2").tobytes() + n.astype("<u4").tobytes()
    return out


def _fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, cost: float = 4.0) -> np.ndarray:
    """Weights of an L2-regularised linear machine with squared hinge loss (dual coordinate descent); the last one is the bias."""
    w, alpha, order = np.zeros(DIMS + 1), np.zeros(len(rows)), np.random.default_rng(7)
    n_pos = max(1, int((y > 0).sum()))
    per = {1: 0.5 / cost * 2 * n_pos / len(y), -1: 0.5 / cost * 2 * max(1, len(y) - n_pos) / len(y)}
    diag = np.array([per[int(s)] for s in y])
    norms = np.array([x @ x for _, x in rows]) + diag
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            g = y[i] * (w[at] @ x) - 1 + diag[i] * alpha[i]
            new = max(alpha[i] - g / norms[i], 0.0)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


def _margins(w: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    return np.array([w[at] @ x for at, x in rows]) * y


def _slope(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, out: np.ndarray) -> float | None:
    """Slope of the logistic that turns a margin into the probability of being right, by maximum likelihood on the rows
    ``out``, which a machine of the others has not seen; one more error than seen is assumed. None: too few rows."""
    seen = [k for k in range(len(rows)) if not out[k]]
    if out.sum() < HELD_OUT_LEAST or len(set(y[seen])) < 2:
        return None
    z = _margins(_fit([rows[k] for k in seen], y[seen]), [rows[k] for k in np.flatnonzero(out)], y[out])
    sure, low, high = 1 - 1 / (len(z) + 2), 0.0, 1e4
    for _ in range(60):  # the likelihood is concave in the slope
        mid = (low + high) / 2
        if (z * (sure - 1 / (1 + np.exp(-np.clip(mid * z, -30, 30))))).sum() > 0:
            low = mid
        else:
            high = mid
    return low


class Model:
    """Machines by level: (first, second, weights, slope) between families, and within each family between languages."""

    def __init__(self, languages: list[str], vectors: list[tuple[str, bytes]]) -> None:
        self.languages = sorted(languages)
        self.members: dict[str, list[str]] = {}
        for lang in self.languages:
            self.members.setdefault(family(lang), []).append(lang)
        rows, langs = [], []
        for lang, data in vectors:
            k = len(data) // 6
            at = np.append(np.frombuffer(data, "<u2", k).astype(np.int64), DIMS)
            n = np.frombuffer(data, "<u4", k, 2 * k).astype(float)
            rows.append((at, np.append(n / n.sum() * SCALE, 1.0)))
            langs.append(lang)
        aside = np.array([crc32(data) % HELD_OUT == 0 for _, data in vectors], bool)  # copies are on one side
        self.machines: list[tuple[str, str, int, float]] = []
        weights = []
        for names, of in [(sorted(self.members), [family(x) for x in langs]), *((m, langs) for m in self.members.values())]:
            for i, first in enumerate(names):
                for second in names[i + 1:]:
                    use = [k for k, x in enumerate(of) if x in (first, second)]
                    some, y = [rows[k] for k in use], np.array([1.0 if of[k] == first else -1.0 for k in use])
                    w, slope = _fit(some, y), _slope(some, y, aside[use])
                    if slope is None:
                        slope = float(3.0 / max(np.median(np.abs(_margins(w, some, y))), 1e-3))
                    self.machines.append((first, second, len(weights), slope))
                    weights.append(w)
        self.weights = np.array([w[:DIMS] * SCALE for w in weights]).reshape(len(weights), DIMS)
        self.bias = np.array([w[DIMS] for w in weights])

    def _choose(self, names: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among names and its share of the votes, votes weighed by confidence."""
        votes, won = np.zeros((len(names), margins.shape[1])), np.ones((len(names), len(names), margins.shape[1]))
        for first, second, k, slope in self.machines:
            if first in names and second in names:
                i, j = names.index(first), names.index(second)
                p = 1 / (1 + np.exp(-np.clip(slope * margins[k], -30, 30)))
                votes[i] += p
                votes[j] += 1 - p
                won[i, j], won[j, i] = p, 1 - p
        best = votes.argmax(0)
        return best, won[best, :, np.arange(margins.shape[1])].min(1)

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        families = sorted(self.members)
        for rows, code, starts in _steps(texts):
            n = np.diff(np.append(starts, len(code)))
            margins = np.array([np.add.reduceat(w[code], starts) / n + b for w, b in zip(self.weights, self.bias, strict=True)]).reshape(len(self.weights), len(rows))
            best, sure = self._choose(families, margins)
            for f, name in enumerate(families):
                at = np.flatnonzero(best == f)
                if len(at):
                    lang, within = self._choose(self.members[name], margins[:, at])
                    for k, i in enumerate(at):
                        langs[rows[i]] = self.members[name][lang[k]]
                        scores[rows[i]] = float(sure[i] * within[k])
        return langs, scores


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE) -> Model:
    """A model from at most ``max_sample`` of the labelled rows with a letter in their text."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h"))
    counts = labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().limit(max_sample + 1).collect()
    if len(counts) > max_sample // 20:
        raise ValueError(f"more than {max_sample // 20} languages: raise max_sample")
    if not counts:
        return Model([], [])
    share = max_sample // len(counts)
    # about one and a half times the share by hash, then exactly the share by rank: the rank never sees more
    limit = F.lit(-(2**63))
    for r in counts:
        part = min(1.0, 1.5 * share / r["count"])
        limit = F.when(F.col("lang") == r["lang"], F.lit(2**63 - 1 if part >= 1 else int(-(2**63) + part * 2.0**64))).otherwise(limit)
    chosen = rows.where(F.col("h") <= limit).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("rank") <= share).select("lang", "text")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"lang": pdf["lang"], "v": _vectors(pdf["text"].tolist())})
            yield out[out["v"].notna()]
            release()

    got = sorted((r["lang"], bytes(r["v"])) for r in chosen.mapInPandas(vectors, "lang string, v binary").collect())
    return Model(sorted({lang for lang, _ in got}), got)


def prediction(model: Model, text: Column) -> Column:
    """Struct (lang_pred, score) of a text; only the text goes to Python."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            langs, scores = model.predict(s.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})
            release()

    return predicted(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    work = fresh("language")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select("*", prediction(model, F.col(text_col)).alias(work)).select(*kept, f"{work}.lang_pred", f"{work}.score")


def learnable(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows the contract lets a model learn from."""
    return docs.where(F.coalesce(bucket(F.col(id_col), 4) != 2, F.lit(True)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(learnable(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
