"""Language identification by hierarchical discrimination.

First a one-vs-rest linear support vector machine for each language family picks
the family, then one-versus-one linear machines vote among the languages within
it.  Features are hashed counts of 2 and 3 bytes of the whole lower-cased text
with other than letters taken as blanks, square-rooted and of unit length.

Training takes a bounded sample of the labelled rows: of each language at most
``PER_LANGUAGE`` different rows, fewer (but one) where that would make more than ``MAX_ROWS`` in all: those
of the smallest hash of id and text.  A caller may leave out all but the most frequent languages (ties to the smaller name).  Their feature vectors are made on the executors.
Everything else covers every row.

Cases: a null text or one without letters is ``und`` with score 0; with no
labelled row every text is ``und``; with one language every other text is that
one; repeated rows and null ids get the answer of their text, repeated rows count once in training;
texts of any length are read whole in pieces; every other column is kept, those named
``lang_pred`` or ``score`` as ``lang_pred_input`` and ``score_input``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, set_aside, small_batches

#: Family of each language code; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en is lb nb nl nn no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
}
DIMENSIONS = 1 << 12
#: Bounds of the training sample: rows of a language, rows in all (16 KB each on the driver; at least one of each language).
PER_LANGUAGE, MAX_ROWS = 400, 8000
UNDETERMINED = "und"
#: Any character that isn't a letter; one byte values that separate words.
has_letter = regex.compile(r"\p{L}").search
BLANKS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
CHUNK = 1 << 16


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed byte n-gram counts, in pieces so that long texts need little memory."""
    raw = (" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass").translate(BLANKS)
    data, out = np.frombuffer(raw, "u1"), np.zeros(DIMENSIONS)
    for at in range(0, max(1, len(data) - 2), CHUNK):
        x = data[at : at + CHUNK + 2].astype("u4")
        two = x[:-1] << np.uint32(8) | x[1:]
        three = two[:-1] << np.uint32(8) | x[2:]
        if at + CHUNK + 2 < len(data):
            two = two[:-1]
        for k, grams in enumerate((two, three)):
            h = (grams + np.uint32(k << 24)) * np.uint32(2654435761)
            out += np.bincount((h >> np.uint32(20)).astype("i8"), minlength=DIMENSIONS)
    out = np.sqrt(out)
    return out / (np.linalg.norm(out) or 1)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 200) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, classes weighted alike, by accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype("f4")
    y = y.astype("f4")
    weight = cost * np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())).astype("f4")
    step = np.float32(1 / (1 + 8 * cost))
    w = v = np.zeros(x.shape[1], "f4")
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * x.T @ (weight * slack * y))
        v, w = new + np.float32(k / (k + 3)) * (new - w), new
    return w.astype("f8")


class Hierarchy:
    """The family machines and, within each family, a machine for each pair of languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        langs_of = np.array(langs, dtype=object)
        names = sorted(set(langs))
        self.members = {f: [x for x in names if family(x) == f] for f in sorted({family(x) for x in names})}
        fams = np.array([family(x) for x in langs], dtype=object)
        self.families = {f: train_svm(x, np.where(fams == f, 1.0, -1.0)) for f in self.members} if len(self.members) > 1 else {}
        self.pairs = {}
        for group in self.members.values():
            for i, a in enumerate(group):
                for b in group[i + 1 :]:
                    own = (langs_of == a) | (langs_of == b)
                    self.pairs[a, b] = train_svm(x[own], np.where(langs_of[own] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.members:
            return UNDETERMINED, 0.0
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -30, 30)))
        best, score = next(iter(self.members)), 1.0
        if self.families:
            margins = {f: float(w[:-1] @ x + w[-1]) for f, w in self.families.items()}
            best = max(margins, key=lambda f: (margins[f], f))
            score = sure(margins[best])
        group = self.members[best]
        votes, margin = dict.fromkeys(group, 0), dict.fromkeys(group, 0.0)
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                w = self.pairs[a, b]
                m = float(w[:-1] @ x + w[-1])
                votes[a if m >= 0 else b] += 1
                margin[a] += m
                margin[b] -= m
        lang = max(group, key=lambda g: (votes[g], margin[g]))
        return lang, float(score * (sure(margin[lang] / (len(group) - 1)) if len(group) > 1 else 1.0))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, languages: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """A hierarchy from at most ``per_language`` rows of each language; of all languages, unless only so many of the most frequent are wanted.

    The rows are picked by their hashes alone; only the picked ones' texts are moved.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("train"))
    rows = small_batches(labelled).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h")).filter("lang is not null and text is not null")
    top = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang")
    top = (top if languages is None else top.limit(languages)).collect()  # one row a language
    langs = sorted(r["lang"] for r in top)
    if not langs:
        return Hierarchy(np.empty((0, DIMENSIONS), "f4"), [])
    most = max(1, min(per_language, MAX_ROWS // len(langs)))
    rows = rows.filter(F.col("lang").isin(langs))
    # first within 8 parts of a language, so that the last window gets a bounded number of rows however common a language is
    least = rows.select("lang", "h")
    for part in (["lang", F.pmod("h", F.lit(8))], ["lang"]):
        least = least.withColumn("r", F.dense_rank().over(Window.partitionBy(*part).orderBy("h"))).filter(F.col("r") <= most).drop("r").distinct()
    limits = {r["lang"]: r["last"] for r in least.groupBy("lang").agg(F.max("h").alias("last")).collect()}  # one row a language
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("lang"))
    picked = rows.filter(F.col("h") <= cut).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            keep = [i for i, x in enumerate(texts) if has_letter(x)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([features(texts[i]).astype("f4").tobytes() for i in keep], pa.binary())], names=["lang", "x"])

    got = picked.select("lang", "text").mapInArrow(run, "lang string, x binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    return Hierarchy(np.array([np.frombuffer(r[1], "f4") for r in got], "f4").reshape(len(got), DIMENSIONS), [r[0] for r in got])


def predict(docs: DataFrame, model: Hierarchy, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score for each row's whole text; every other column is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a machine for each pair of languages within a family: as large as the list of languages

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        m = shared.value
        got = [m.predict(features(x)) if x is not None and has_letter(x) else (UNDETERMINED, 0.0) for x in (t.as_py() for t in texts)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["lang_pred", "score"])

    docs = set_aside(small_batches(docs), "lang_pred", "score")
    made = free_name(docs, "__language")
    out = docs.withColumn(made, run.asNondeterministic()(F.col(text_col)))  # so declared, it runs once whatever filters follow
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{made}.lang_pred").alias("lang_pred"), F.col(f"{made}.score").alias("score"))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the decimal id mod 5 is 0; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
