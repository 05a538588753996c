"""Toxicity by a counterfactually regularised classifier.

A logistic model over words and word beginnings. Identity terms in labelled
sentences are swapped for others of their kind, and the model pays for any change
of its score that a swap makes, so a group's mention alone neither raises nor
lowers it. Features are chosen and weights fitted on a bounded sample of the
labelled rows (``most_rows``, half of it for each label); every text is scored
whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.llm.common import crc_mod, cut

MOST_ROWS, MOST_FEATURES, LEAST_ROWS = 12_000, 4096, 8
ROWS_AT_ONCE = 256
BEGINNINGS = (5, 6, 7, 8)
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Words that name a group, by kind; a swap stays within a kind.
IDENTITY_TERMS = {
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres".split(),
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists sikh atheist muslime christen juden musulman chrétien juif musulmán cristiano judío".split(),
    "origin": "african asian european american arab mexican chinese indian turkish polish german french spanish russian immigrant immigrants refugee refugees ausländer immigré inmigrante".split(),
    "colour": "black white brown latino latina hispanic indigenous schwarze weiße noir blanc negro blanco".split(),
    "orientation": "gay lesbian bisexual queer straight heterosexual homosexual lesbisch schwul".split(),
    "ability": "deaf blind disabled autistic elderly old young behinderte handicapé discapacitado".split(),
}
KIND_OF = {w: kind for kind, words in IDENTITY_TERMS.items() for w in words}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features_of(words: set[str]) -> set[str]:
    """Each word; the beginnings of longer words (compounds, endings); and those that two or more of the words have."""
    n = Counter(beginnings(words))
    return {f"={w}" for w in words} | {f"^{x}" for x in n} | {f"2{x}" for x, k in n.items() if k > 1}


def beginnings(words: set[str]) -> list[str]:
    return [w[:n] for n in BEGINNINGS for w in words if len(w) > n]


def swapped(text: str) -> str | None:
    """The text with identity terms swapped within their kind, sentence by sentence; None if it has none."""
    found = False

    def sentence(m: re.Match) -> str:
        shift = zlib.crc32(m[0].encode())

        def other(w: re.Match) -> str:
            nonlocal found
            word = w[0].lower()
            if word not in KIND_OF:
                return w[0]
            found = True
            kind = IDENTITY_TERMS[KIND_OF[word]]
            return kind[(kind.index(word) + 1 + shift % (len(kind) - 1)) % len(kind)]

        return WORD.sub(other, m[0])

    out = SENTENCE.sub(sentence, text)
    return out if found else None


def _feature_batches(batches):
    for b in batches:
        own, other = [], []
        for t in b.column(0).to_pylist():
            own.append(sorted(features_of(words_of(t))))
            s = swapped(t) if t else None
            other.append(None if s is None else sorted(features_of(words_of(s))))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), pa.array(other, pa.list_(pa.string())), b.column(1)], ["own", "other", "toxic"])


def _index_batches(index: dict[str, int]):
    def run(batches):
        for b in batches:
            at = lambda fs: None if fs is None else [index[f] for f in fs if f in index]
            yield pa.RecordBatch.from_arrays([pa.array([at(x) for x in b.column(i).to_pylist()], pa.list_(pa.int32())) for i in (0, 1)] + [b.column(2)], ["own", "other", "toxic"])

    return run


def fit(rows: list[tuple[list[int], list[int] | None, int]], n_features: int, toxic_share: float, pull: float = 1.0, l1: float = 5e-4, l2: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept: mean log loss (weighted to the share of toxic rows among all labels), plus ``pull`` times the mean squared score change under swaps, plus L1 and L2."""
    y = np.array([r[2] for r in rows], np.float64)
    flat = lambda part: (np.repeat(np.arange(len(part)), [len(x) for x in part]), np.array([i for x in part for i in x], np.int64))
    r, c = flat([x[0] for x in rows])
    pairs = [(x[0], x[1]) for x in rows if x[1] is not None]
    pr, pc = flat([[*a, *b] for a, b in pairs])
    sign = np.array([s for a, b in pairs for s in [1.0] * len(a) + [-1.0] * len(b)])
    w, bias, m, v = np.zeros(n_features), 0.0, np.zeros(n_features + 1), np.zeros(n_features + 1)
    share = np.where(y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum()))
    for t in range(1, steps + 1):
        score = np.bincount(r, w[c], len(y)) + bias
        g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * share
        gw = np.bincount(c, g[r], n_features) + l2 * w
        if pairs:
            change = np.bincount(pr, sign * w[pc], len(pairs))
            gw += 2 * pull / len(pairs) * np.bincount(pc, sign * change[pr], n_features)
        grad = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 * (1 - 0.9 * t / steps)
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = scale * m / (1 - 0.9**t)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * np.minimum(scale[:-1], 50), 0)
        bias -= step[-1]
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> tuple[dict[str, float], float]:
    """(weights by feature, intercept) from labelled rows whose crc32(doc_id) mod 5 is not 0.

    At most ``most_rows`` labels are used: of each class the first half of that by
    a hash of doc_id. Null ids, labels and texts are not learned from. With no
    labels all weights are 0 and so is the intercept.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", 5) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows // 2) for k in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # most_rows rows at most
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id"), F.col("text")).join(chosen, "doc_id").select("text", "toxic")
    rows = cut(texts.mapInArrow(_feature_batches, "own array<string>, other array<string>, toxic int"))
    sums = rows.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    total = rows.agg(F.sum("toxic").cast("double"), F.count(F.lit(1)).cast("double")).first()
    a, n = total[0] or 0.0, total[1]
    if not 0 < a < n:
        return {}, 0.0 if not n else (4.0 if a else -4.0)
    expected = F.col("n") * (a / n)
    chi = F.pow(F.col("a") - expected, 2) / (expected * (1 - a / n) * (1 - F.col("n") / (n + 1)))
    names = [x["f"] for x in sums.filter(F.col("n") >= LEAST_ROWS).orderBy(F.desc(chi), "f").limit(MOST_FEATURES).collect()]
    names += [f"={w}" for w in KIND_OF if f"={w}" not in set(names)]
    index = {f: i for i, f in enumerate(names)}
    got = rows.mapInArrow(_index_batches(index), "own array<int>, other array<int>, toxic int").collect()  # most_rows short lists of numbers
    every = usable.agg(F.avg("toxic")).first()[0]
    w, bias = fit([(x["own"], x["other"], x["toxic"]) for x in sorted(got, key=lambda x: (x["toxic"], x["own"]))], len(names), every)
    return {f: float(w[i]) for f, i in index.items() if w[i]}, bias


def _score_batches(weights: dict[str, float], bias: float, text, done):
    """``text`` gives a batch's texts, ``done`` what to return of the batch and its scores; few rows at a time become Python strings."""
    whole = {f[1:]: w for f, w in weights.items() if f[0] == "="}
    begin = {f[1:]: w for f, w in weights.items() if f[0] == "^"}
    twice = {f[1:]: w for f, w in weights.items() if f[0] == "2"}

    def run(batches):
        names, starts = whole.keys(), begin.keys() | twice.keys()
        for b in (big.slice(i, ROWS_AT_ONCE) for big in batches for i in range(0, big.num_rows, ROWS_AT_ONCE)):
            out = []
            for t in text(b).to_pylist():
                words = words_of(t)
                n = Counter(x for x in beginnings(words) if x in starts)
                x = bias + sum(whole[w] for w in sorted(words & names)) + sum(begin.get(w, 0.0) + (twice.get(w, 0.0) if n[w] > 1 else 0.0) for w in sorted(n))
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, x)))))
            yield done(b, pa.array(out, pa.float64()))

    return run


def score(docs: DataFrame, model: tuple[dict[str, float], float], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, and score (0 to 1) of each whole text; a null text is scored as empty."""
    name = "__toxicity_text"
    rows = docs.select(*keep, F.col("text").alias(name))
    fields = [f for f in rows.schema.fields if f.name != name]

    def done(b, scores):
        return pa.RecordBatch.from_arrays([*b.columns[:-1], scores], [*b.schema.names[:-1], "score"])

    return rows.mapInArrow(_score_batches(*model, lambda b: b.column(b.num_columns - 1), done), StructType([*fields, StructField("score", DoubleType())]))


def remove_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without those scored ``limit`` or more; columns and other rows are kept as they are."""
    name = "__toxicity_row"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))

    def done(b, scores):
        return b.filter(pa.compute.less(scores, limit))

    kept = rows.mapInArrow(_score_batches(*train(docs, labels), lambda b: pa.compute.struct_field(b.column(0), "text"), done), rows.schema)
    return kept.select(f"{name}.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
