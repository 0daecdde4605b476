"""Language ID by a byte convolutional network, trained in numpy and applied to all windows of a text.

Filters of several widths run over the bytes of a window (a filter's weights are a table by offset and byte), the
largest response of each over the window is rectified, and a softmax layer gives the languages' probabilities. A text
is cut into windows of fixed length, the last padded with zero bytes; its probabilities are the windows' mean, weighted
by their bytes.

Training uses a sample of labelled rows of bounded expected size: ``per_language`` rows of each language (all, if there
are fewer), one stretch of ``STRETCH`` characters of each, chosen by hashes. Null languages teach nothing.

Nulls: a null text, or one without a letter, is ``und`` with score 0; so is every text if no row can be learned from.
Repeated rows and null ids keep their rows; ties go to the language that sorts first. An empty table gives an empty
result. Other columns are kept as they are by ``predict``, but for those that have the names of its own two, in any case:
they give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import mapped
from .common import fresh

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4, 5), 10
PER_LANGUAGE, STRETCH, EPOCHS, BATCH, RATE = 400, 2000, 6, 64, 0.01
FOLDS = 5
LETTER = regex.compile(r"\p{L}")
#: Bytes that are scored at once.
AT_ONCE = 2048


@dataclass
class ByteCnn:
    languages: list[str]
    tables: list[np.ndarray]  # by width: offsets x 256 x filters
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    pairs: list = field(default_factory=list)

    def byte_pairs(self) -> list[tuple[list[np.ndarray], np.ndarray | None]]:
        """By width: filters x 65536 responses to pairs of bytes at offsets 0, 2, ..., and to the odd byte at the end."""
        return [([(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1).T.copy() for k in range(0, len(t) - 1, 2)], t[-1].T.copy() if len(t) % 2 else None) for t in self.tables]

    def features(self, x: np.ndarray) -> np.ndarray:
        """Largest responses of all filters over each window: windows x filters."""
        if not self.pairs:
            self.pairs = self.byte_pairs()
        ids = x.astype(np.intp)
        pairs = ids[:, :-1] * 256 + ids[:, 1:]
        out = []
        for table, (twos, one) in zip(self.tables, self.pairs):
            width, n = len(table), x.shape[1] - len(table) + 1
            for f in range(table.shape[2]):
                r = np.take(twos[0][f], pairs[:, :n])
                for k in range(1, len(twos)):
                    r += np.take(twos[k][f], pairs[:, 2 * k : 2 * k + n])
                if one is not None:
                    r += np.take(one[f], ids[:, width - 1 : width - 1 + n])
                out.append(r.max(axis=1))
        return np.maximum(np.stack(out, axis=1) + self.bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.top + self.top_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.languages:
            return out
        rows, owner, held = [], [], 0
        total, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))

        def score() -> None:
            at = np.concatenate(owner)
            x = np.concatenate(rows)
            n = (x != 0).sum(axis=1).astype(float)
            np.add.at(total, at, self.probabilities(x) * n[:, None])
            np.add.at(weight, at, n)
            rows.clear()
            owner.clear()

        for k, t in enumerate(texts):
            if t and LETTER.search(t):
                w = windows(t.encode("utf-8", "replace"))
                for a in range(0, len(w), AT_ONCE):
                    rows.append(w[a : a + AT_ONCE])
                    owner.append(np.full(len(rows[-1]), k))
                    held += len(rows[-1])
                    if held >= AT_ONCE:
                        score()
                        held = 0
        if rows:
            score()
        for k in np.nonzero(weight)[0]:
            p = total[k] / weight[k]
            best = int(p.argmax())
            out[k] = (self.languages[best], float(min(1.0, p[best])))
        return out


def windows(data: bytes) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data + bytes(n * WINDOW - len(data)), np.uint8).reshape(n, WINDOW)


def train(samples: list[tuple[str, str]], seed: int = 4) -> ByteCnn:
    """Fit by Adam on windows of the samples (language, text), some cut short so that short texts are learned too."""
    languages = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    x, y = [], []
    for lang, text in sorted(samples):
        for w in windows(text.encode("utf-8", "replace")):
            keep = int((w != 0).sum())
            if rng.random() < 0.4:
                keep = min(keep, int(rng.integers(8, 96)))
            row = w.copy()
            row[keep:] = 0
            x.append(row)
            y.append(languages.index(lang))
    tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias, top = np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    top_bias = np.zeros(len(languages), np.float32)
    model = ByteCnn(languages, tables, bias, top, top_bias)
    if len(languages) < 2:
        return model
    x, y = np.array(x), np.array(y)
    params = [*tables, bias, top, top_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    weight = (weight / weight.max()).astype(np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            b = order[k : k + BATCH]
            xb, yb = x[b].astype(np.intp), y[b]
            pooled, where = [], []
            for t in tables:
                w, n = len(t), WINDOW - len(t) + 1
                r = sum(t[o][xb[:, o : o + n]] for o in range(w))
                at = r.argmax(axis=1)
                pooled.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
                where.append(at)
            h = np.concatenate(pooled, axis=1) + bias
            a = np.maximum(h, 0)
            z = a @ top + top_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(len(b)), yb] -= 1
            d *= weight[yb][:, None] / len(b)
            dh = (d @ top.T) * (h > 0)
            grads = []
            for i, t in enumerate(tables):
                g, part = np.zeros_like(t), dh[:, i * FILTERS : (i + 1) * FILTERS]
                for o in range(len(t)):
                    np.add.at(g[o], (np.take_along_axis(xb, where[i] + o, axis=1), np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [dh.sum(axis=0), a.T @ d, d.sum(axis=0)]
            step += 1
            rate = RATE * (1 if epoch < EPOCHS - 2 else 0.3)
            for p, g, mm, vv in zip(params, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return model


def held_out() -> Column:
    """Whether a row is of the fold that teaches nothing."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCnn:
    """A network for the languages of the rows outside the held-out fold."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = 1 + F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - STRETCH, F.lit(1)))
    got = rows.where(draw < share).select("lang", F.substring("text", start.cast("int"), F.lit(STRETCH)).alias("text"))
    return train([(r[0], r[1]) for r in got.collect()])


def predict(docs: DataFrame, model: ByteCnn, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, from the text alone."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (pred.lower(), score.lower())])
    known, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        for b in batches:
            got = net.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*b.schema.names, pred, score])

    return mapped(docs, run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), learn(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """``docs`` without those of no language, or of none with a score of ``least``."""
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    return predict(docs, learn(docs), pred, score).where((F.col(pred) != "und") & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
