"""Language identification by a string kernel.

Kernel: two texts are compared by the sets of letter n-grams (n = 1, 2, 3;
blended spectrum) they hold: common n-grams over the geometric mean of both
counts. N-grams are held as bits of a table of DIMS places. Training: Nystroem
features from landmark texts, then one-versus-rest kernel ridge regression.
Since a score is linear in a text's bits, landmarks and weights are folded
into one matrix, and whole batches are scored by a matrix product. A long text
is scored by pieces, all of them, so that a foreign passage counts by its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_remainder, small_batches

DIMS = 1 << 15
BATCH = 64
PIECE = 1024
SLICE = 1 << 20
SAMPLE = 3000
LANDMARKS = 256
RIDGE = 1e-3
NONE = "und"

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter
    if _letter is None:
        _letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letter


def mark(text: str | None, row: np.ndarray) -> bool:
    """Sets the bits of a text's n-grams in row; False if the text has no letter."""
    letter, seen = _letters(), False
    for at in range(0, len(text or ""), SLICE):
        c = np.frombuffer(text[max(0, at - 2) : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = letter[c]
        seen = seen or bool(known.any())
        c = np.where(known, c, 32).astype(np.uint32)
        row[(c * np.uint32(2654435761)) >> np.uint32(17)] = 1
        two = c[:-1] * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35) + np.uint32(1)
        row[_mix(two)] = 1
        three = c[:-2] * np.uint32(0x27D4EB2F) + c[1:-1] * np.uint32(0x165667B1) + c[2:] * np.uint32(0x9E3779B1) + np.uint32(2)
        row[_mix(three)] = 1
    return seen


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39) >> np.uint32(17)


class Model:
    """labels, and the matrix that takes normalised bits to one score a label."""

    def __init__(self, labels: list[str], weights: np.ndarray):
        self.labels, self.weights = labels, weights

    def scores(self, bits: np.ndarray) -> np.ndarray:
        x = bits.astype(np.float32)
        return (x @ self.weights) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Scorer:
    """Scores texts by pieces of PIECE characters: the mean over a text's pieces, by their length.

    Pieces of several texts share a matrix product, so memory is bounded by BATCH rows of bits.
    """

    def __init__(self, model: Model):
        self.model = model
        self.bits = np.zeros((BATCH, DIMS), np.uint8)

    def __call__(self, texts) -> tuple[list[str], list[float]]:
        spoken, owners, sizes = [], [], []
        sums: list[np.ndarray] = []
        total: list[int] = []

        def flush():
            f = self.model.scores(self.bits[: len(owners)])
            for o, n, v in zip(owners, sizes, f):
                sums[o] += n * v
                total[o] += n
            self.bits[: len(owners)] = 0
            owners.clear()
            sizes.clear()

        for k, text in enumerate(texts):
            text = text or ""
            spoken.append(False)
            sums.append(np.zeros(len(self.model.labels)))
            total.append(0)
            for at in range(0, len(text), PIECE):
                piece = text[at : at + PIECE]
                if mark(piece, self.bits[len(owners)]):
                    spoken[k] = True
                    owners.append(k)
                    sizes.append(len(piece))
                    if len(owners) == BATCH:
                        flush()
                else:
                    self.bits[len(owners)] = 0
        if owners:
            flush()
        langs, scores = [], []
        for ok, f, n in zip(spoken, sums, total):
            best = int(f.argmax())
            langs.append(self.model.labels[best] if ok else NONE)
            scores.append(float(np.clip((f[best] / n + 1) / 2, 0, 1)) if ok else 0.0)
        return langs, scores


def chosen_piece(text: str, number: int) -> str:
    """One of the pieces by which a text is scored."""
    at = number % max(1, -(-len(text) // PIECE)) * PIECE
    return text[at : at + PIECE]


def _normal(bits: np.ndarray) -> np.ndarray:
    x = bits.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """bits: a row for each text; langs: its label."""
    labels = sorted(set(langs))
    place = {v: i for i, v in enumerate(labels)}
    y = -np.ones((len(bits), len(labels)))
    y[np.arange(len(bits)), [place[v] for v in langs]] = 1
    chosen = np.linspace(0, len(bits) - 1, min(landmarks, len(bits))).round().astype(int)
    marks = _normal(bits[np.unique(chosen)])
    val, vec = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = val > 1e-6 * val.max()
    root = vec[:, keep] / np.sqrt(val[keep])
    z = np.concatenate([_normal(bits[i : i + BATCH]) @ marks.T for i in range(0, len(bits), BATCH)]) @ root
    w = np.linalg.solve(z.T @ z + ridge * len(z) * np.eye(z.shape[1]), z.T @ y)
    return Model(labels, (marks.T @ (root @ w)).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model | None:
    """Fits on the rows of docs (doc_id, text, lang) with a text and a lang.

    At most `sample` rows, in equal shares of the labels, are used: those with
    the smallest hashes of doc_id; of more than `sample` labels the most
    frequent. Of each a piece of PIECE characters is learned from, as texts are
    scored by such pieces; which one, its hash tells. None if there is no such
    row. Pieces are turned into bits by the executors, so what is collected is
    bounded by sample * DIMS / 8 bytes (about twice that before the last cut).
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("lm_h"))
    small_batches(docs.sparkSession)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return None
    share = max(1, sample // len(counts))
    below = F.lit(False)
    for lang, n in counts.items():
        part = min(1.0, (1.3 * share + 20) / n)
        at = (1 << 63) - 1 if part == 1 else int((2 * part - 1) * 2**63)
        below = below | ((F.col("lang") == lang) & (F.col("lm_h") <= F.lit(at)))

    def to_bits(batches):
        for batch in batches:
            out = []
            for x, h in zip(batch.column(1), batch.column(3).to_pylist()):
                row = np.zeros(DIMS, np.uint8)
                mark(chosen_piece(x.as_py(), h), row)
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(out, pa.binary())], names=["lang", "h", "bits"])

    got = rows.where(below).mapInArrow(to_bits, "lang string, h long, bits binary").toPandas().sort_values(["h", "lang", "bits"])
    got = got.groupby("lang").head(share).sort_values(["h", "lang", "bits"])
    bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in got["bits"]]), axis=1)
    return fit(bits, got["lang"].tolist(), landmarks)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, with lang_pred string and score double (0 to 1).

    Kept columns that are named lang_pred or score are replaced. A null text, or one without a letter, has lang_pred `und` and score 0; so
    have all texts if there is no model. Whole texts are read, in
    pieces, so memory is bounded by a batch of bits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.select(*keep).schema)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = keep.index("text") if "text" in keep else len(keep)

    def scan(batches):
        score = Scorer(shared.value) if shared.value else None
        for batch in batches:
            n = batch.num_rows
            langs, scores = score(x.as_py() for x in batch.column(at)) if score else ([NONE] * n, [0.0] * n)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], *[F.col("text").alias("lm_text")] * (at == len(keep)))
    return rows.mapInArrow(scan, schema).toDF(*keep, "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_remainder(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learns from the rows that are not held out and predicts all of them.

    Rows with a null doc_id are predicted but not learned from. Repeated rows
    get the same result each. Columns other than doc_id, text, lang and `keep`
    are not read.
    """
    model = train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return predict(docs, model, keep or ["doc_id"])
