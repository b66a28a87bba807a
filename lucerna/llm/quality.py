"""A quality classifier learned from positives and unlabelled text.

Risk: with g the model's logit, l the logistic loss, p the class prior and means over trusted positives (P) and
unlabelled text (U), the non-negative unbiased risk is
    p * mean_P l(g) + max(0, mean_U l(-g) - p * mean_P l(-g)).
Where the second part falls below zero, the step goes against that part alone, which undoes its overfitting.
The prior is estimated from positives and unlabelled text alone: a first model tells the two apart, and on halves that it wasn't
fitted on, the share of unlabelled text above a threshold, over the share of positives above it, is nowhere less than the prior
but for chance, and comes down to it where negatives end; the least such ratio, with bounds for chance, is taken. Negative
labels serve for nothing. Positives and unlabelled rows are bounded samples, the `SAMPLE` rows of each with the smallest
hashes of their ids, so they are spread over the whole table; only their feature rows reach the driver.

Features describe whole texts (character classes, repetition of words and lines, lengths, and the shares of words by a hash into
`BUCKETS`); ids, languages and sources are never among them. Every text is scored, in one scan.

Defined results: null and empty texts have the features of an empty text and get a score too; a null id counts as
the text '' for the held-out rule; repeated rows each get a row; with no positives or no unlabelled rows every
score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import list_column, map_rows, raw, short_batches, sliced

#: Rows of positives and of unlabelled text that the model is fitted on, at most.
SAMPLE = 20_000
THRESHOLD, FOLDS, HELD = 0.7, 4, 2
#: Hidden units, steps, rows of each kind in a step, step size, weight decay.
HIDDEN, STEPS, STEP_ROWS, RATE, DECAY, SEED = 16, 6000, 512, 0.01, 3e-3, 7
#: Steps between looks at the risk of rows held back, and how many looks without a lower one end the fit.
LOOK, PATIENCE = 25, 60
#: Hash buckets of words.
BUCKETS = 64


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[[ord(c) for c in chars]] = 1
    return out


#: Classes of bytes.
CLASSES = np.column_stack([
    _mask("abcdefghijklmnopqrstuvwxyz"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789"), _mask(" \t"), _mask("\n\r"),
    _mask(".,;:'\"?()-"), _mask("!"), _mask("#$%&*+=<>@^_~\\/"), _mask("|"), _mask("{}[]`"), (np.arange(256) >= 0xC0).astype(float),
])
PLAIN = CLASSES.shape[1] + 10
WIDTH = PLAIN + BUCKETS


def features(text: bytes) -> np.ndarray:
    """Shares of character classes, then figures of words and lines, then shares of hashed words; all between 0 and about 2."""
    out = np.zeros(WIDTH)
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = counts @ CLASSES
    k = len(kinds)
    out[:k] = kinds / kinds.sum().clip(1)
    parts = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m = len(parts), len(lines)
    letters = (kinds[0] + kinds[1]) or 1
    out[k] = kinds[1] / letters
    out[k + 1] = min(2.0, len(text) / max(1, n) / 10)
    if n:
        tally = Counter(parts)
        distinct = len(tally)
        out[PLAIN:] = np.bincount(np.fromiter(map(crc32, tally), np.int64, distinct) % BUCKETS, np.fromiter(tally.values(), float, distinct), BUCKETS) / n
        out[k + 2] = distinct / n
        out[k + 3] = np.log1p(distinct) / np.log1p(n)
        out[k + 4] = sum(a == b for a, b in zip(parts, parts[1:])) / n
        out[k + 5] = len({*zip(parts, parts[1:])}) / max(1, n - 1)
    out[k + 6] = np.log1p(n) / 10
    if m:
        out[k + 7] = len({*lines}) / m
        out[k + 8] = min(2.0, n / m / 50)
    out[k + 9] = min(2.0, 10 * counts[46] / max(1, n))
    return out


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


# ---- the model ----


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["mean"]) / model["scale"]
    return np.tanh(z @ model["a"] + model["b"]) @ model["c"] + model["d"] + z @ model["e"]


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "prior" in model:
        return np.full(len(x), model["prior"])
    return 1 / (1 + np.exp(-np.clip(logits(model, x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, total: int = STEPS, seed: int = SEED) -> dict:
    """A network of one hidden layer beside a linear part, by Adam on the risk above; with no prior, on the plain risk of telling
    positives from unlabelled rows, which overfits: there a tenth of the rows is held back, and the weights with the least risk on
    them are kept."""
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    d = positive.shape[1]
    w = {"a": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b": np.zeros(HIDDEN), "c": np.zeros(HIDDEN), "d": np.zeros(1), "e": np.zeros(d)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    zp, zu = (rng.permutation(np.clip((x - mean) / scale, -20, 20)) for x in (positive, unlabelled))
    kept = [max(1, len(z) // 10) if len(z) > 10 and prior is None else 0 for z in (zp, zu)]
    (vp, zp), (vu, zu) = ((z[:n] if n else z, z[n:]) for z, n in zip((zp, zu), kept))
    out = lambda z: np.tanh(z @ w["a"] + w["b"]) @ w["c"] + w["d"] + z @ w["e"]

    risk = lambda: np.logaddexp(0, -out(vp)).mean() + np.logaddexp(0, out(vu)).mean()
    steps = max(1, min(len(zp), len(zu)) // STEP_ROWS)
    t, passes = 0, -(-total // steps)  # small samples get as many steps
    least, best, since = np.inf, w, 0
    for _ in range(passes):
        ps, us = np.array_split(rng.permutation(len(zp)), steps), np.array_split(rng.permutation(len(zu)), steps)
        for pi, ui in zip(ps, us):
            t += 1
            z = np.concatenate([zp[pi], zu[ui]])
            h = np.tanh(z @ w["a"] + w["b"])
            g = h @ w["c"] + w["d"] + z @ w["e"]
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # the slope of l(-g) is s, that of l(g) is s - 1
            n, m = len(pi), len(ui)
            if prior is None:
                slope = np.concatenate([(s[:n] - 1) / n, s[n:] / m])
            else:
                soft = np.logaddexp(0, g)
                rest = soft[n:].mean() - prior * soft[:n].mean()
                negative = np.concatenate([-prior * s[:n] / n, s[n:] / m])
                slope = -negative if rest < 0 else negative
                if rest >= 0:
                    slope[:n] += prior * (s[:n] - 1) / n
            back = slope[:, None] * w["c"] * (1 - h * h)
            grad = {"a": z.T @ back, "b": back.sum(0), "c": h.T @ slope, "d": np.array([slope.sum()]), "e": z.T @ slope}
            rate = RATE * (1 - 0.9 * min(1.0, t / total))
            for k, v in w.items():
                gk = grad[k] + DECAY * v
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.999 * second[k] + 0.001 * gk * gk
                v -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
            if prior is None and t % LOOK == 0:
                now = risk()
                since = 0 if now < least else since + 1
                if now < least:
                    least, best = now, {k: v.copy() for k, v in w.items()}
                if since == PATIENCE:
                    return {"mean": mean, "scale": scale, **best}
    return {"mean": mean, "scale": scale, **best}


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> float:
    """The share of positives among unlabelled rows, estimated from the two samples alone: each half is judged by a model of the other
    half, and the least ratio of the shares above a threshold is taken, each with a bound for its chance deviation."""
    rng = np.random.default_rng(seed)
    halves = [np.array_split(x[rng.permutation(len(x))], 2) for x in (positive, unlabelled)]
    found = []
    for k in (0, 1):
        model = fit(halves[0][1 - k], halves[1][1 - k], None, STEPS // 6, seed + k)
        p, u = (np.sort(logits(model, x[k])) for x in halves)
        cuts = np.unique(np.concatenate([p, u]))
        above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
        chance = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
        near = above_p > 0
        place = np.argmin(((above_u + chance) / np.maximum(above_p, 1e-9))[near])  # the bound chooses the threshold
        found.append((above_u[near] / above_p[near])[place])
    return float(np.clip(np.mean(found), 0.02, 0.98))


def feature_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the features of every row's text."""

    def run(batches):
        for b in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), list_column(np.concatenate([features(t) for t in raw(b.column(1))]).astype(np.float32), np.full(b.num_rows, WIDTH), pa.float32())], ["id", "x"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> dict:
    """Fit on rows whose ids aren't held out."""
    short_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull())

    def gather(ids: DataFrame) -> np.ndarray:
        """Features of the documents of the ids with the smallest hashes; at most `sample` ids."""
        few = ids.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
        rows = feature_rows(docs.select(id_col, text_col).join(F.broadcast(few), id_col, "left_semi"), id_col, text_col)
        got = rows.groupBy("id").agg(F.min("x").alias("x")).orderBy("id").toArrow().column("x")  # a repeated id is one row
        return pc.list_flatten(got).to_numpy().astype(np.float64).reshape(-1, WIDTH)

    positive = gather(known.where(F.col(label_col) == 1))
    unlabelled = gather(docs.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()))
    if len(positive) < 2 or len(unlabelled) < 2:
        return {"prior": 0.5}
    return fit(positive, unlabelled, class_prior(positive, unlabelled))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches, 1):
            p = probability(shared.value, np.array([features(t) for t in raw(b.column(1))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(df: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores at least `threshold`; all rows if the model had nothing to learn from."""
    if "prior" in model:
        return df
    spark = df.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for b in sliced(batches, at):
            keep = probability(shared.value, np.array([features(t) for t in raw(b.column(at))])) >= threshold
            yield b.filter(pa.array(keep))

    return map_rows(df, run)
