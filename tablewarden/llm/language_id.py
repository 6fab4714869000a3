"""Language identification by string kernels.

The kernel of two texts counts the byte n-grams (one to three bytes of the lower-cased text, blended)
that both hold, divided by the root of the product of how many each holds. Only n-grams that some
landmark text holds are counted. Kernels with the landmarks give Nystrom features, on which one ridge
regression per language tells it from the rest. Texts are scored in batches: a presence matrix times
the landmarks' presence matrix gives the kernels, and these times the weights the scores.

Fitting takes at most ``per_class`` labelled texts of a language, chosen by a hash, and of a text longer
than ``longest`` characters a window of that length at a place the hash names; with at most
``most_languages`` labels (more are an error) that bounds what reaches the driver whatever the size of
the corpus. Every text is scored whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text when
nothing was learned; rows without a label are scored but not learned from; rows with a null id are
neither learned from nor held out; equal scores go to the first language by name; repeated rows repeat;
an empty table gives no rows; columns ``lang_pred`` and ``score`` of the input are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shipped
from .texts import slices

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Fit:
    per_class: int = 240
    longest: int = 6_000
    most_languages: int = 1_000
    landmarks: int = 24
    longest_gram: int = 3
    ridge: float = 0.1
    batch: int = 256


def grams(raw: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of joined texts, and the text of each; none goes over a border."""
    if len(raw) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(raw) - size + 1
    code = np.zeros(n, dtype=np.int64)
    for k in range(size):
        code = (code << 8) | raw[k : n + k]
    inside = text[:n] == text[size - 1 :]
    return code[inside], text[:n][inside]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.repeat(np.arange(len(raw)), [len(r) for r in raw])


@dataclass
class Model:
    """``codes``: for each n-gram size the sorted codes of the landmarks; ``landmarks``: their scaled presence, n-grams by landmarks."""

    languages: list[str]
    codes: list[np.ndarray]
    landmarks: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def prepare(self) -> None:
        """Tables from code to column; made once per worker."""
        self.tables, self.width = [], 1
        for size, known in enumerate(self.codes, 1):
            table = np.zeros(1 << 8 * size, dtype=np.int32)
            table[known] = np.arange(self.width, self.width + len(known))
            self.tables.append(table)
            self.width += len(known)

    def presence(self, texts: list[str]) -> np.ndarray:
        """Texts by n-grams, rows scaled to length one; column 0 takes what no landmark holds and is cleared."""
        raw, text = _joined(texts)
        out = np.zeros((len(texts), self.width), dtype=np.float32)
        for size, table in enumerate(self.tables, 1):
            code, row = grams(raw, text, size)
            out[row, table[code]] = 1
        out[:, 0] = 0
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    def scores(self, texts: list[str]) -> np.ndarray:
        kernel = self.presence(texts) @ self.landmarks
        return kernel @ self.weights + self.offset


def fitted(texts: list[str], labels: list[str], fit: Fit = Fit()) -> Model | None:
    """``texts`` in a fixed order; the first of each language are its landmarks."""
    languages = sorted(set(labels))
    if not languages:
        return None
    chosen = [i for name in languages for i in [k for k, label in enumerate(labels) if label == name][: fit.landmarks]]
    raw, text = _joined([texts[i] for i in chosen])
    codes = [np.unique(grams(raw, text, size)[0]) for size in range(1, fit.longest_gram + 1)]
    model = Model(languages, codes, np.zeros(0), np.zeros(0), np.zeros(0))
    model.prepare()
    model.landmarks = np.ascontiguousarray(model.presence([texts[i] for i in chosen]).T)
    between = (model.landmarks.T @ model.landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(between)
    large = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, large] / np.sqrt(values[large])
    kernel = np.concatenate([model.presence(texts[i : i + fit.batch]) @ model.landmarks for i in range(0, len(texts), fit.batch)])
    features = kernel.astype(np.float64) @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Languages weigh the same however many texts they have.
    share = 1.0 / np.bincount([languages.index(x) for x in labels])[[languages.index(x) for x in labels]]
    share = (share / share.sum())[:, None]
    centre, middle = (share * features).sum(axis=0), (share * target).sum(axis=0)
    near, aim = features - centre, target - middle
    solved = np.linalg.solve((near * share).T @ near + fit.ridge / len(texts) * np.eye(near.shape[1]), (near * share).T @ aim)
    model.weights = (root @ solved).astype(np.float32)
    model.offset = (middle - centre @ solved).astype(np.float32)
    del model.tables
    return model


def training_rows(df: DataFrame, fit: Fit) -> tuple[list[str], list[str]]:
    """At most ``per_class`` texts per language of rows (doc_id, text, lang), those with the least hashes."""
    usable = df.select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("place"))
    usable = usable.where("lang IS NOT NULL AND text != ''")
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).limit(fit.most_languages + 1).collect()
    if len(counts) > fit.most_languages:
        raise ValueError(f"column lang has more than {fit.most_languages} labels")
    if not counts:
        return [], []
    # About twice as many as needed, so that few languages come short by chance. Texts are not shuffled by language.
    limits = [(r["lang"], min(1.0, 2.0 * fit.per_class / r["rows"]) * float(1 << 63)) for r in counts]
    limits = df.sparkSession.createDataFrame(limits, "lang string, limit double")
    near = usable.join(F.broadcast(limits), "lang").where(F.col("place") < F.col("limit"))
    start = F.col("place") % F.greatest(F.length("text") - fit.longest + 1, F.lit(1)) + 1
    near = near.select("place", "lang", F.substr("text", start.cast("int"), F.lit(fit.longest)).alias("text"))
    rows = sorted(near.toLocalIterator(), key=lambda r: (r["place"], r["text"]))
    kept: dict[str, list[str]] = {}
    for row in rows:
        kept.setdefault(row["lang"], []).append(row["text"])
    pairs = [(text, lang) for lang in sorted(kept) for text in kept[lang][: fit.per_class]]
    return [t for t, _ in pairs], [lang for _, lang in pairs]


def languages(docs: DataFrame, model: Model | None, text: str = "text", batch_size: int = Fit.batch) -> DataFrame:
    """The rows with ``lang_pred`` and ``score`` (0 to 1, half way at equal evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Model | None = shared.value
        if known is not None and not hasattr(known, "tables"):
            known.prepare()
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            for part in slices(batch.column(place)):
                texts = batch.column(place)[part.first : part.last].to_pylist()
                rows = [i for i, t in enumerate(texts) if known is not None and t and LETTER.search(t)]
                for at in range(0, len(rows), batch_size):
                    own = rows[at : at + batch_size]
                    found = known.scores([texts[i] for i in own])
                    best = found.argmax(axis=1)
                    for i, k, s in zip(own, best.tolist(), found.max(axis=1).tolist(), strict=True):
                        names[part.first + i] = known.languages[k]
                        scores[part.first + i] = min(1.0, max(0.0, (s + 1) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(scores, pa.float64())], names=schema.names)

    return shipped(kept).mapInArrow(run, schema)
