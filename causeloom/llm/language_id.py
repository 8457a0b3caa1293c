"""Hierarchical language identification.

The family of a text is predicted first; within the family one-versus-one linear
support vector machines separate the closely related languages and vote.

Features are hashed character n-grams (1 to 3 bytes of the lower-cased text; all
ASCII characters but letters count as a blank), square-rooted and scaled to unit
length, over the whole text.  The machines are fitted on the driver from at most
``SAMPLE`` labelled rows of each language, chosen by a hash of the id; every labelled
language is learned.  What is sent to the driver and broadcast is bounded by that and
by the number of languages.  Prediction is a map over all rows and shuffles
nothing.

Rows whose CRC-32 of the id (as text) is 2 modulo 4 are held out and never learned
from.  Language, source and id are never inputs of a prediction.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
and every text if no labelled row exists; rows without a language are predicted
but not learned from; a null id counts as the empty text in the CRC; repeated rows
are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import apart
from .staging import give_back

BINS = 4096
#: Most labelled rows of one language that are learned from.
SAMPLE = 400
UNKNOWN = "und"
#: Weight of the penalty, and steps of the solver.
PENALTY, STEPS = 1e-4, 120

# Language codes by family.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
#: Bytes of lower-cased UTF-8 to bytes that count: ASCII but a-z is a blank.
_KEPT = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def family_of(language: str) -> str:
    """The family of a language code; codes not listed share one family."""
    return _FAMILY_OF.get(language.split("-")[0].lower(), "other")


def features(text: str) -> np.ndarray:
    """Unit vector of hashed n-gram frequencies of the whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_KEPT) + b" ", np.uint8).astype(np.uint32)
    one, two, three = data, data[:-1] * np.uint32(257) + data[1:], None
    three = two[:-1] * np.uint32(263) + data[2:]
    counts = np.zeros(BINS, np.float64)
    for salt, grams in ((1, one[one != 32]), (2, two[two != 32 * 257 + 32]), (3, three)):
        mixed = (grams + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(20), minlength=BINS)
    vector = np.sqrt(counts)
    return (vector / max(np.linalg.norm(vector), 1e-12)).astype(np.float32)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (and bias last) of a linear machine with squared hinge loss; y is -1 or 1, classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, before = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = 1 / (2 * 2 + PENALTY)
    for step in range(STEPS):
        ahead = w + (step / (step + 3)) * (w - before)
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = PENALTY * ahead - 2 * (x.T @ (share * y * slack))
        before, w = w, ahead - rate * gradient
    return w


class Hierarchy:
    """Machines between families (one against the rest) and between the languages of each."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.families = sorted({family_of(l) for l in languages})
        self.members = {f: sorted(l for l in languages if family_of(l) == f) for f in self.families}
        kind = np.array([family_of(languages[k]) for k in y])
        name = np.array([languages[k] for k in y])
        rows: list[np.ndarray] = []
        if len(self.families) > 1:
            rows += [fit_machine(x, np.where(kind == f, 1.0, -1.0)) for f in self.families]
        self.pairs = {f: [(a, b) for i, a in enumerate(m) for b in m[i + 1 :]] for f, m in self.members.items()}
        for f in self.families:
            for a, b in self.pairs[f]:
                chosen = (name == a) | (name == b)
                rows.append(fit_machine(x[chosen], np.where(name[chosen] == a, 1.0, -1.0)))
        weights = np.array(rows, np.float32) if rows else np.zeros((0, BINS + 1), np.float32)
        self.weights, self.bias = weights[:, :BINS], weights[:, BINS]

    def predict(self, vector: np.ndarray) -> tuple[str, float]:
        margins = self.weights @ vector + self.bias
        sure = lambda m: 1 / (1 + np.exp(-4 * m))
        at, family, score = 0, self.families[0], 1.0
        if len(self.families) > 1:
            at = len(self.families)
            k = int(np.argmax(margins[:at]))
            family, score = self.families[k], float(sure(margins[k]))
        for f in self.families:
            if f == family:
                break
            at += len(self.pairs[f])
        votes = {l: [0, 0.0] for l in self.members[family]}
        own = {l: 1.0 for l in votes}
        for (a, b), m in zip(self.pairs[family], margins[at:]):
            for l, signed in ((a, float(m)), (b, -float(m))):
                votes[l][0] += signed >= 0 if l == a else signed > 0
                votes[l][1] += signed
                own[l] = min(own[l], float(sure(signed)))
        best = max(sorted(votes), key=lambda l: votes[l])
        return best, float(min(1.0, max(0.0, score * own[best])))


def labelled_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and the feature vectors and language numbers of the rows that are learned from."""
    usable = docs.where(F.col(lang_col).isNotNull() & (F.col(lang_col) != UNKNOWN) & ~held_out(id_col))
    counted = usable.groupBy(lang_col).count().collect()
    languages = sorted(r[0] for r in counted)
    if not languages:
        return [], np.zeros((0, BINS), np.float32), np.zeros(0, int)
    order = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"))
    share = F.create_map(*[F.lit(v) for r in counted for v in (r[0], min(1.0, 2.0 * sample / r[1]))])
    likely = usable.where(
        F.col(lang_col).isin(languages) & (F.pmod(order, F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20))
    ).select(F.col(lang_col).alias("lang"), order.alias("o"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(l, o, features(t)) for l, o, t in zip(*(c.to_pylist() for c in batch.columns)) if t and _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2].astype("<f2").tobytes() for r in rows], pa.binary()),
            ], names=["lang", "o", "x"])

    first = Window.partitionBy("lang").orderBy("o")  # of about twice as many rows as are kept
    rows = (
        likely.mapInArrow(run, "lang string, o long, x binary")
        .withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
        .orderBy("lang", "o").select("lang", "x").collect()
    )
    number = {l: i for i, l in enumerate(languages)}
    x = np.array([np.frombuffer(r.x, "<f2") for r in rows], np.float32).reshape(len(rows), BINS)
    y = np.array([number[r.lang] for r in rows], int)
    seen = sorted(set(y.tolist()))
    return [languages[k] for k in seen], x, np.array([seen.index(k) for k in y.tolist()], int)


def fit(docs: DataFrame, **columns) -> Hierarchy | None:
    languages, x, y = labelled_sample(docs, **columns)
    return Hierarchy(languages, x, y) if languages else None


def predict(docs: DataFrame, model: Hierarchy | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score under ``names``; columns of these names stay as ``name_input``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = apart(docs, names, own=[text_col])
    spec = docs.sparkSession.createDataFrame([], f"{names[0]} string, {names[1]} double").schema
    at = docs.columns.index(text_col)
    from pyspark.sql.types import StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hierarchy = shared.value
        for batch in batches:
            found = [
                hierarchy.predict(features(t)) if hierarchy is not None and t and _LETTER.search(t) else (UNKNOWN, 0.0)
                for t in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, *names],
            )
        give_back()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *spec.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang"))
    found = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
