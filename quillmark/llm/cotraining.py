"""Quality classifier by co-training two views.

The text view sees a document's words: hashed word frequencies and how they are written (repetition,
capitals, marks). The metadata view sees what a page's record tells without its text: source, language,
the pair of both, and the recorded length. Each view's logistic regression is
fitted on labelled rows; then, round by round, each labels the unlabelled rows it is most confident of
for the other. Both are calibrated on labelled rows held out, combined by a third fit on them, and score every document.

Labelled rows are a sample bounded by ``labelled`` (smallest id hashes, whole texts). In each round all unlabelled
rows are scored, and the surest of each view, at most a tenth of ``unlabelled``, are fitted on. Only features of
fitted rows, never texts, come to the driver. Scoring covers all rows in one pass over the table. Where the held-out
rows, or the others, lack a kind, all labelled rows serve as both.

Defined results: a null or empty text has no words and scores by what remains; null source, language
or labels count as a value of their own, and rows with a null label or doc_id are not fitted on;
without labelled rows of both kinds every score is 1; a doc_id labelled twice counts as its worst label; of different
rows with one doc_id one is fitted on, by a hash of the row. Only doc_id, text, source, lang and n_chars are read,
other columns are carried along. An empty table gives no model and no rows; very long texts are read whole.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from . import common

#: Hashed dimensions of the text view's words and of the metadata view's names.
WORDS, NAMES = 4096, 256
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-_")
_UPPER, _SMALL = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
TEXT_DIMS, META_DIMS = WORDS + 8, NAMES + 3
#: Confident alone: scores further than this from an even chance.
SURE = 0.45


def text_view(texts: pa.Array) -> np.ndarray:
    named, counts = B.words(texts, lower=True)
    each = common.objects(named.dictionary.cast(pa.large_binary()))
    at = (np.fromiter(map(xxhash.xxh32_intdigest, each), np.int64, len(each)) % WORDS)[named.indices.to_numpy()]
    doc = np.repeat(np.arange(len(counts)), counts)
    f = np.bincount(doc * WORDS + at, minlength=len(counts) * WORDS).reshape(-1, WORDS)
    same = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (at[1:] == at[:-1])], minlength=len(counts))
    out = np.zeros((len(counts), TEXT_DIMS), np.float32)
    for i, (n, t) in enumerate(zip(counts.tolist(), B.texts(pa.table({"t": texts}), "t"))):
        if not n:
            continue
        out[i, :WORDS] = np.sqrt(f[i] / n)
        size = len(t)
        marks, upper, small = (size - len(t.translate(None, kind)) for kind in (_MARKS, _UPPER, _SMALL))
        out[i, WORDS:] = ((f[i] > 0).sum() / min(n, WORDS), same[i] / n, 10 * marks / size, upper / max(1, upper + small), f[i].max() / n, np.log1p(n) / 10, size / n / 10, marks / n > 0.5)
    return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), META_DIMS))
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        size = max(n or 0, 0)
        for name in (f"s:{s}", f"l:{g}", f"s:{s} l:{g}", f"n:{size.bit_length()}"):
            out[i, xxhash.xxh32_intdigest(name.encode()) % NAMES] = 1
        out[i, NAMES:] = np.log1p(size) / 10, n is None, 1.0
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float, steps: int = 300) -> np.ndarray:
    """Logistic regression with an intercept, both classes of equal weight, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = weight * np.where(y > 0.5, 0.5 / max(1e-9, weight[y > 0.5].sum()), 0.5 / max(1e-9, weight[y <= 0.5].sum()))
    w, v, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4.0 / max(1e-9, weight @ np.einsum("ij,ij->i", x, x))
    for k in range(steps):
        p = share(x @ v.astype(x.dtype))
        g = x.T @ (weight * (p - y)).astype(x.dtype) + decay * np.append(v[:-1], 0)
        new = v - rate * g
        w, v = new, new + k / (k + 3) * (new - w)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The weights with the slope and intercept worked in that fit (x, y) best."""
    slope, base = fit(logit(x, w)[:, None], y, np.ones(len(y)), 1e-4, 400)
    return np.append(slope * w[:-1], slope * w[-1] + base)


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    meta: np.ndarray
    #: Slope and intercept that calibrate each view, the weights that combine them, and the least score kept.
    cal_text: np.ndarray
    cal_meta: np.ndarray
    both: np.ndarray
    least: float

    def scores(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = logit(logit(t, self.text)[:, None], self.cal_text)
        b = logit(logit(m, self.meta)[:, None], self.cal_meta)
        return share(a), share(b), share(logit(np.stack([a, b], 1), self.both))


def cotrain(t: np.ndarray, m: np.ndarray, y: np.ndarray, surest: Callable, rounds: int = 3, share_kept: float = 0.995, decay: float = 1e-5) -> Model:
    """Fit on labelled features (t, m, y: 1 is good) and on those that ``surest`` (text and meta weights) gives for
    each view in turn: (t, m) of the unlabelled rows it is most confident of."""
    held = np.arange(len(y)) % 4 == 0
    used = ~held
    if min(len(np.unique(y[held] > 0.5)), len(np.unique(y[used] > 0.5))) < 2:
        held = used = np.ones(len(y), bool)
    views, told = [t[used], m[used]], [y[used], y[used]]
    weights = [np.ones(used.sum()), np.ones(used.sum())]
    for r in range(rounds + 1):
        wt, wm = fit(views[0], told[0], weights[0], decay), fit(views[1], told[1], weights[1], decay)
        if r == rounds:
            break
        # How sure a view is counts after calibration on the held-out rows: a view that knows nothing tells nothing.
        sure_of = [calibrated(w, x[held], y[held]) for w, x in ((wt, t), (wm, m))]
        for mine, found in enumerate(surest(*sure_of)):
            p = share(logit(found[mine], sure_of[mine]))
            sure = np.abs(p - 0.5) > SURE
            views[1 - mine] = np.vstack([views[1 - mine], found[1 - mine][sure]])
            told[1 - mine] = np.concatenate([told[1 - mine], (p[sure] > 0.5).astype(float)])
            weights[1 - mine] = np.concatenate([weights[1 - mine], np.full(sure.sum(), 0.3)])
    ht, hm, hy = t[held], m[held], y[held]
    one = np.ones(len(hy))
    a, b = logit(ht, wt), logit(hm, wm)
    cal_t, cal_m = fit(a[:, None], hy, one, 1e-4, 400), fit(b[:, None], hy, one, 1e-4, 400)
    both = fit(np.stack([logit(a[:, None], cal_t), logit(b[:, None], cal_m)], 1), hy, one, 1e-4, 400)
    model = Model(wt, wm, cal_t, cal_m, both, 0.0)
    good = np.sort(model.scores(ht, hm)[2][hy > 0.5])
    # Never more than an even chance is asked for, and at least ``share_kept`` of the good held-out rows stay.
    least = min(0.5, good[int((1 - share_kept) * len(good))])
    return Model(wt, wm, cal_t, cal_m, both, float(least))


def _features(rows: DataFrame) -> DataFrame:
    """(y, view, at, value): sparse features of sampled rows, as two lists each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = text_view(b.column(0)).astype("<f4")
            m = meta_view(*(b.column(i).to_pylist() for i in (1, 2, 3))).astype("<f4")
            packed = []
            for r in t:
                at = np.flatnonzero(r)
                packed.append(at.astype("<u2").tobytes() + r[at].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(packed, pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], names=["y", "t", "m"])

    return rows.mapInArrow(work, "y double, t binary, m binary")


def _dense(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, m = np.zeros((len(rows), TEXT_DIMS), np.float32), np.zeros((len(rows), META_DIMS), np.float32)
    for i, r in enumerate(rows):
        n = len(r.t) // 6
        t[i, np.frombuffer(r.t[: 2 * n], "<u2")] = np.frombuffer(r.t[2 * n :], "<f4")
        m[i] = np.frombuffer(r.m, "<f4")
    return t, m, np.array([r.y if r.y is not None else np.nan for r in rows])


def surest(docs: DataFrame, told: DataFrame, wt: np.ndarray, wm: np.ndarray, taken: set[int], most: int) -> list[list[int]]:
    """Ids of the unlabelled rows, of all in ``docs``, that each view is most confident of; ties by hash of the id."""
    common.arrow_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((wt, wm))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                views = text_view(b.column(0)), meta_view(*(b.column(k).to_pylist() for k in (1, 2, 3)))
                sure = [np.abs(share(logit(x, w)) - 0.5).astype(float) for x, w in zip(views, held.value)]
                yield pa.RecordBatch.from_arrays([b.column(4), *map(pa.array, sure)], names=["doc_id", "s0", "s1"])

    rows = docs.filter("doc_id is not null").select("text", "source", "lang", "n_chars", F.col("doc_id").cast("long").alias("doc_id"))
    sure = rows.mapInArrow(work, "doc_id long, s0 double, s1 double").filter((F.col("s0") > SURE) | (F.col("s1") > SURE))
    sure = common.materialise(sure.join(told.select("doc_id"), "doc_id", "left_anti"), "sure", small=True)
    out = []
    for s in ("s0", "s1"):
        best = sure.filter(F.col(s) > SURE).filter(~F.col("doc_id").isin(*taken) if taken else F.lit(True))
        out.append([r.doc_id for r in best.groupBy("doc_id").agg(F.max(s).alias(s)).orderBy(F.desc(s), F.xxhash64("doc_id")).limit(most).collect()])
    common.drop_scratch(sure)
    return out


def train(docs: DataFrame, labels: DataFrame, labelled: int = 2400, unlabelled: int = 1600, rounds: int = 3) -> Model | None:
    """Fit on at most ``labelled`` labelled documents, chosen by hash of their id, and in each round on at most a
    tenth of ``unlabelled`` more for each view, the surest of all unlabelled documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    told = labels.filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min(F.col("good").cast("double")).alias("y"))
    ids = docs.select("doc_id").filter("doc_id is not null")
    pick = told.join(ids, "doc_id", "left_semi").select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    # Half of the labelled sample for either label, as far as there are rows.
    part = pick.filter("y > 0.5").orderBy("h").limit(labelled // 2).union(pick.filter("y <= 0.5").orderBy("h").limit(labelled // 2))

    def features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # The ids of a sample are bounded by the parameters, so they are broadcast.
        rows = docs.join(F.broadcast(sample), "doc_id").withColumn("row", F.struct("text", "source", "lang", "n_chars", "y"))
        rows = rows.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        found = _features(rows.select("row.*")).collect()
        found.sort(key=lambda r: xxhash.xxh64_intdigest(r.t + r.m))
        return _dense(found)

    t, m, y = features(part.select("doc_id", "y"))
    if len(np.unique(y > 0.5)) < 2:
        return None
    taken: set[int] = set()

    def more(wt: np.ndarray, wm: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = surest(docs, told, wt, wm, taken, max(1, unlabelled // 10))
        taken.update(*found)
        spark = docs.sparkSession
        return [features(spark.createDataFrame([(i, None) for i in ids], "doc_id long, y double"))[:2] for ids in found]

    return cotrain(t, m, y, more, rounds)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` plus, as the last four, p_text, p_meta, quality_score and keep; where ``docs`` has such a
    name, the new column's gets underscores behind it."""
    common.arrow_rows(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = [names.index(c) for c in ("text", "source", "lang", "n_chars")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                if held.value is None:
                    p = q = s = np.ones(b.num_rows)
                    keep = np.ones(b.num_rows, bool)
                else:
                    p, q, s = held.value.scores(text_view(b.column(at[0])), meta_view(*(b.column(k).to_pylist() for k in at[1:])))
                    keep = s >= held.value.least
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(q), pa.array(s), pa.array(keep)], names=[*b.schema.names, "p_text", "p_meta", "quality_score", "keep"])

    schema = T.StructType(list(inner.schema.fields))
    for n, kind in (("p_text", "double"), ("p_meta", "double"), ("quality_score", "double"), ("keep", "boolean")):
        schema = schema.add(n, kind)
    return inner.mapInArrow(work, schema).toDF(*names, *common.free(("p_text", "p_meta", "quality_score", "keep"), names))
