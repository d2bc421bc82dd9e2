"""Language identification: the family first, then linear SVMs between the languages of that family."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import slices
from regolith.llm.linear import ngram_rows, sigmoid, squared_hinge
from regolith.llm.textscan import buffer_of

UNKNOWN = "und"
BITS = 11
#: Documents of each language, and of all, that the classifiers are fitted on, on average at most.
SAMPLE, SAMPLE_OF_ALL = 400, 8000
#: Fixed: families of languages by their codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru pl cs sk uk bg sr hr bs sl mk be",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indo-aryan": "hi bn mr gu pa ur ne",
    "semitic": "ar he mt am",
    "celtic": "ga cy br gd",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@dataclass
class Model:
    """families: the languages of each; between: coefficients by pair of families; within: by pair of languages."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    within: dict[tuple[str, str], np.ndarray]


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """SVMs for each pair of families and for each pair of languages within a family."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(_FAMILY.get(lang, lang), []).append(lang)
    own = np.array(langs)
    of = np.array([_FAMILY.get(lang, lang) for lang in langs])

    def pairs(names: list[str], labels: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        out = {}
        for a, b in itertools.combinations(names, 2):
            here = (labels == a) | (labels == b)
            out[a, b] = squared_hinge(x[here], np.where(labels[here] == a, 1, -1).astype(np.float32))
        return out

    within = {k: w for names in families.values() for k, w in pairs(names, own).items()}
    return Model(families, pairs(sorted(families), of), within)


def _vote(names: list[str], between: dict[tuple[str, str], np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the name that wins most duels (of equals the one that wins by more), and how sure its duels are."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    wins, sure = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for (a, b), w in between.items():
        if a in names and b in names:
            i, j = names.index(a), names.index(b)
            p = sigmoid(2 * (x @ w[:-1] + w[-1]))
            wins[:, i] += p >= 0.5
            wins[:, j] += p < 0.5
            sure[:, i] += p
            sure[:, j] += 1 - p
    best = (wins + sure / len(names)).argmax(1)
    return best, sure[np.arange(len(x)), best] / (len(names) - 1)


def predict(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row and a score of 0 to 1."""
    names = sorted(model.families)
    family, sure = _vote(names, model.between, x)
    out, score = np.full(len(x), UNKNOWN, object), np.zeros(len(x))
    for k, name in enumerate(names):
        here = np.flatnonzero(family == k)
        if len(here):
            langs = model.families[name]
            own, more = _vote(langs, model.within, x[here])
            out[here] = np.array(langs, object)[own]
            score[here] = sure[here] * more
    return out, score


def _rows(column: pa.Array) -> Iterator[np.ndarray]:
    yield from ngram_rows(*buffer_of(column), BITS)


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | None:
    """Fits on rows where `learn` holds and the language is known, chosen by a hash of their id, about `sample` of each
    language and SAMPLE_OF_ALL in all. Only their vectors of 2**BITS numbers come to the driver. None if there are no such rows."""
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    sample = max(1, min(sample, SAMPLE_OF_ALL // max(1, counts.count())))
    chosen = known.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("id", F.lit(9)), F.greatest("n", F.lit(sample))) < sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = np.concatenate(list(_rows(batch.column(2)))).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "lang", "x"])

    got = chosen.select("id", "lang", "text").mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("lang", "ascending"), ("id", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), "<f4").reshape(got.num_rows, 1 << BITS)
    return fit(x, got.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """The language of every whole text: id_col, with with_text also text_col, then lang_pred and score (0 to 1).

    Hashed n-grams of bytes of the text alone decide on the family by one-versus-one linear SVMs, then on the language among
    that family's by others. `und` with score 0 if the text is null or has no letter, or if there is no model. A row for each
    row of docs; null ids stay null; other columns do not pass. A text is read in pieces, so a long one needs little beside it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            mute = np.array([not any(map(str.isalpha, t or "")) for t in batch.column(1).to_pylist()])
            if sent.value is None:
                langs, score = np.full(len(mute), UNKNOWN, object), np.zeros(len(mute))
            else:
                found = [predict(sent.value, x) for x in _rows(batch.column(1))]
                langs, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            langs[mute], score[mute] = UNKNOWN, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + with_text], pa.array(langs, pa.string()), pa.array(score)], names=["id", *["text"] * with_text, "lang_pred", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, " + "text string, " * with_text + "lang_pred string, score double"
    return texts.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "text": text_col})


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text, mod `parts`, is `part`; true for a null id, so that nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(True))
