"""Language identification by hierarchical discrimination with linear support vector machines.

First the language family is predicted, then one-versus-one machines separate the languages within it. All
machines work on hashed character n-grams of the whole text (lengths 1 to 3, square roots of the counts, unit
length). They are fitted on a bounded sample of labelled documents, each machine in a task of its own; their
weights (languages x machines x DIMS numbers, independent of the corpus) are broadcast for prediction.

Null texts and texts without a letter are `und`; very long texts are read whole; rows that repeat are predicted each; other columns
of the documents, whatever their names, are neither read nor returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from randaudit.llm.common import appended, bounded_batches, forget, texts

DIMS = 4096
#: Labelled documents of one language in the fitting sample, about and at most.
SAMPLE_PER_LANG = 400
UNKNOWN = "und"
#: Families of common languages (ISO 639-1). A language not named here is a family of its own.
FAMILIES = {
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "pa"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter (Unicode category L); number characters such as Ⅻ, ① or ½ are none."""
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def family(lang: str) -> str:
    return _FAMILY.get(lang, f"other:{lang}")


def features(text: str) -> np.ndarray:
    """Unit vector of hashed character n-grams of the whole lower-cased text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.zeros(DIMS)
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(3):
        h = (h[: len(codes) - n] * np.uint32(0x01000193)) ^ codes[n:]
        mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
        counts += np.bincount(mixed >> np.uint32(32 - 12), minlength=DIMS)
        h = h[:-1] if n < 2 else h
    root = np.sqrt(counts)
    return root / np.linalg.norm(root)


def _packed(x: np.ndarray) -> bytes:
    """Places and values of the features that are not 0: at most 6 * DIMS bytes, however long the text is."""
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n, out = len(raw) // 6, np.zeros(DIMS)
    out[np.frombuffer(raw, "<u2", n)] = np.frombuffer(raw, "<f4", n, 2 * n)
    return out


def _fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = 20, c: float = 10.0) -> np.ndarray:
    """Weights (bias last) of a linear SVM with hinge loss, by dual coordinate descent in a fixed order."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w, alpha, norms = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    # Both sides weigh the same, however many documents each has.
    bound = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def machines(langs: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """(name, languages of the one side, of the other) of every machine: families pairwise, then languages pairwise in each."""
    families: dict[str, list[str]] = {}
    for lang in sorted(langs):
        families.setdefault(family(lang), []).append(lang)
    names = sorted(families)
    out = [(f"family|{a}|{b}", families[a], families[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    return out + [(f"{f}|{a}|{b}", [a], [b]) for f in names for i, a in enumerate(families[f]) for b in families[f][i + 1 :]]


def fit(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> dict:
    """The model {langs, weights by machine} from labelled (doc_id, text, lang).

    Of each language a sample of about per_lang documents is taken by a hash of text and doc_id, evenly over
    all documents; rows equal in all three are one. What travels to a machine's task is bounded: a sample's features.
    Rows with a null lang or a text without a letter are left out. No label: an empty model.
    """
    bounded_batches(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return {"langs": [], "weights": {}}
    key = (F.pmod(F.xxhash64("text", F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1_000_000)) / 1_000_000).alias("u")
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.1 * per_lang / n)))])
    named = machines(list(counts))
    plan = [(name, lang, side) for name, a, b in named for side, langs in ((1, a), (-1, b)) for lang in langs]
    todo = F.create_map(*[x for lang in counts for x in (F.lit(lang), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("y")) for n, l, s in plan if l == lang]))]) if plan else None
    if todo is None:
        return {"langs": sorted(counts), "weights": {}}
    sample = usable.where(key < share[F.col("lang")]).select("doc_id", "text", "lang", F.xxhash64("text").alias("h"))
    # Features have a bounded size, texts don't; rows that repeat collapse before the shuffle.
    def make() -> Callable:
        forget()
        return lambda batch: [[_packed(features(t)) for t in batch.column("text").to_pylist()]]

    told = appended(sample, make, "x binary", drop=("text",))
    once = told.groupBy("lang", "doc_id", "h").agg(F.first("x").alias("x"))
    flat = once.select("lang", "doc_id", "h", "x", F.explode(todo[F.col("lang")]).alias("m")).select("lang", "doc_id", "h", "x", "m.name", "m.y")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lang", "doc_id", "h"], kind="stable").groupby("lang").head(2 * per_lang)
        x = np.array([_unpacked(b) for b in pdf["x"]])
        return pd.DataFrame({"name": [pdf["name"].iloc[0]], "w": [_fit_svm(x, pdf["y"].to_numpy(dtype=float))]})

    rows = flat.groupBy("name").applyInPandas(train, "name string, w array<double>").collect()  # one row a machine
    return {"langs": sorted(counts), "weights": {r["name"]: np.array(r["w"]) for r in rows}}


def _decide(x: np.ndarray, names: list[str], level: str, weights: dict) -> tuple[str, float]:
    """The winner of pairwise votes (ties: larger sum of margins, then the first by name) and a score of 0 to 1."""
    if len(names) == 1:
        return names[0], 1.0
    votes, margins, lowest = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, np.inf)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            w = weights[f"{level}|{a}|{b}"]
            m = float(x @ w[:-1] + w[-1])
            votes[a if m >= 0 else b] += 1
            for name, own in ((a, m), (b, -m)):
                margins[name] += own
                lowest[name] = min(lowest[name], own)
    best = min(names, key=lambda n: (-votes[n], -margins[n], n))
    return best, float(1 / (1 + np.exp(-3 * np.clip(lowest[best], -50, 50))))


def classify(text: str | None, model: dict) -> tuple[str, float]:
    """(language, score). A null text, one without a letter, and any text under an empty model: ("und", 0.0)."""
    if not model["langs"] or not has_letter(text):
        return UNKNOWN, 0.0
    families: dict[str, list[str]] = {}
    for lang in model["langs"]:
        families.setdefault(family(lang), []).append(lang)
    x = features(text)
    first, p = _decide(x, sorted(families), "family", model["weights"])
    second, q = _decide(x, sorted(families[first]), first, model["weights"])
    return second, p * q


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score; docs has a text column and neither of these two."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: machines x DIMS weights

    def make() -> Callable:
        forget()
        own = shared.value

        def columns(batch: pa.RecordBatch) -> list:
            out = [classify(t, own) for t in batch.column("text").to_pylist()]
            return [[x[0] for x in out], [x[1] for x in out]]

        return columns

    return appended(docs, make, "lang_pred string, score double")


def lettered(docs: DataFrame) -> DataFrame:
    """The documents that have a letter: those that predict() gives a language, unless its model is empty."""
    bounded_batches(docs.sparkSession)
    found = appended(docs, lambda: lambda batch: [[has_letter(t) for t in batch.column("text").to_pylist()]], "has_letter boolean")
    return found.where("has_letter").drop("has_letter")


def learnable(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the documents that may be learned from: crc32 of the doc_id as text, modulo 4, is not 2.

    A null doc_id has no such number: its document is neither learned from nor held out.
    """
    return texts(docs, "lang").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, by a model learned from the others' labels."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return predict(texts(docs).withColumn("held_out", held), fit(learnable(docs))).select("doc_id", "held_out", "lang_pred", "score")
