"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

N-grams are four bytes of the UTF-8 text, ASCII letters lower-cased and everything else in
ASCII folded to spaces, hashed to a fixed number of buckets. Training counts them per
language over all labelled rows. A document is a mixture of languages: its proportions are
fitted by EM, first over all languages, then without the lightest one, and so on; the
language set with the best penalised likelihood wins. A document whose likelihood cannot
rise by more than the penalty when any second language is mixed in (the likelihood is concave
in the proportions, so its slope bounds the gain) is settled without EM.

Defined cases: null texts and texts without letters get ``und`` and score 0, as does every
text if nothing can be learned; rows with a null language or null id teach nothing; repeated
rows are judged (and learned from) row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAM = 4
PENALTY = 4.0
ROUNDS = 8
NONE = "und"
#: Bytes of text that are fitted together; longer texts are folded to counts of buckets.
SLICE = 1 << 17

_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PAD = b"   "


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def gram_buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all four-byte windows of a folded text, and which of them hold a letter."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    word = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return (word * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1), word != np.uint32(0x20202020)


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(c.isalpha() for c in text[:64]) or any(map(str.isalpha, text)))


def _folded(texts: list[str | None]):
    """Slices of texts as (first index, joined bytes, starts of each text's windows): texts stand between three spaces, so no window sees two."""
    at, parts, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace").translate(_FOLD)
        parts.append(raw)
        size += len(raw)
        if size >= SLICE or i + 1 == len(texts):
            sizes = np.fromiter((len(p) + 3 for p in parts), np.int64, len(parts))
            yield at, _PAD + _PAD.join(parts) + _PAD, np.concatenate([[0], np.cumsum(sizes)])
            at, parts, size = i + 1, [], 0


@dataclass
class Model:
    """``ratio[bucket, language]``: likelihood relative to the bucket's likeliest language."""

    languages: list[str]
    ratio: np.ndarray


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all training rows: each task adds up its own rows before anything is shuffled."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, t in zip(langs, texts):
                by_lang.setdefault(lang, []).append(t)
            for lang, group in by_lang.items():
                mine = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, raw, _ in _folded(group):
                    bucket, letters = gram_buckets(raw)
                    mine += np.bincount(bucket[letters], minlength=BUCKETS)
        for lang, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["lang", "bucket", "n"])

    per_task = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, bucket int, n bigint")
    return per_task.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """Learn from ``text, lang`` of the training rows. The driver gets at most ``BUCKETS`` numbers per language."""
    found = count_grams(docs).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        mine = found[found["lang"] == lang]
        counts[mine["bucket"].to_numpy(), k] = mine["n"].to_numpy()
    p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)
    return Model(languages, (p / p.max(axis=1, keepdims=True)).astype(np.float32) if languages else p.astype(np.float32))


def _em(ratio: np.ndarray, weight: np.ndarray, starts: np.ndarray, owner: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few EM rounds from proportions ``w`` (zeros stay zero), and the likelihood they reach. ``owner``: each row's document."""
    total = np.add.reduceat(weight, starts)[:, None]
    for _ in range(ROUNDS):
        joint = ratio * w[owner]
        joint *= (weight / joint.sum(axis=1))[:, None]
        w = np.add.reduceat(joint, starts) / total
    reached = (ratio * w[owner]).sum(axis=1)
    return w, np.add.reduceat(np.log(np.maximum(reached, 1e-30)) * weight, starts)


def proportions(ratio: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Language proportions of documents whose n-grams lie in consecutive rows from ``starts`` on; languages outside the chosen set have 0."""
    n_docs, n_lang = len(starts), ratio.shape[1]
    sizes = np.diff(np.append(starts, len(ratio)))
    owner = np.repeat(np.arange(n_docs), sizes)
    grams = np.add.reduceat(weight, starts)
    single = np.add.reduceat(np.log(ratio) * weight[:, None], starts)
    best = single.argmax(axis=1)
    out = np.zeros((n_docs, n_lang))
    out[np.arange(n_docs), best] = 1.0
    # windows overlap, so a language must pay for GRAM times the evidence that one window gives
    price = PENALTY * GRAM * np.log(grams + 1.0)
    own = ratio[np.arange(len(ratio)), best[owner]]
    slope = np.add.reduceat(ratio / own[:, None] * weight[:, None], starts) - grams[:, None]
    slope[np.arange(n_docs), best] = -np.inf
    open_docs = np.flatnonzero(slope.max(axis=1) > price) if n_lang > 1 else np.zeros(0, np.int64)
    if not len(open_docs):
        return out
    chosen = np.zeros(n_docs, bool)
    chosen[open_docs] = True
    rows = chosen[owner]
    ratio, weight, price = ratio[rows], weight[rows], price[open_docs]
    starts = np.concatenate([[0], np.cumsum(sizes[open_docs])[:-1]])
    owner = np.repeat(np.arange(len(open_docs)), sizes[open_docs])
    top, value = out[open_docs], single[open_docs, best[open_docs]] - price
    w = np.full((len(open_docs), n_lang), 1.0 / n_lang)
    for size in range(n_lang, 1, -1):
        w, reached = _em(ratio, weight, starts, owner, w)
        better = reached - size * price > value
        value = np.where(better, reached - size * price, value)
        top[better] = w[better]
        kept = np.where(w > 0, w, np.inf)
        drop = kept.argmin(axis=1)
        w = w.copy()
        w[np.arange(len(w)), drop] = 0.0
        w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-30)
    out[open_docs] = top
    return out


def infer(texts: list[str | None], model: Model) -> list[tuple[str, float, dict[str, float]]]:
    """(language, score, proportions) of each text; the score is the language's proportion."""
    out: list = [(NONE, 0.0, {})] * len(texts)
    if not model.languages:
        return out
    for first, raw, bounds in _folded(texts):
        bucket, letters = gram_buckets(raw)
        sizes = np.add.reduceat(letters.astype(np.int64), np.minimum(bounds[:-1], len(letters) - 1))
        full = [i for i in np.flatnonzero(sizes > 0) if has_letter(texts[first + i])]
        if not full:
            continue
        if len(bucket) > 2 * SLICE:  # one long text, alone or at the end of the slice: fold it to counts
            per_doc = [np.unique(bucket[bounds[i] : bounds[i + 1]][letters[bounds[i] : bounds[i + 1]]], return_counts=True) for i in full]
            index, weight = np.concatenate([u for u, _ in per_doc]), np.concatenate([c for _, c in per_doc]).astype(np.float32)
            lengths = np.array([len(u) for u, _ in per_doc])
        else:
            keep = letters.copy()
            for i in np.setdiff1d(np.arange(len(sizes)), full):
                keep[bounds[i] : bounds[i + 1]] = False
            index, lengths = bucket[keep], sizes[full]
            weight = np.ones(len(index), np.float32)
        w = proportions(model.ratio[index], weight, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        lead = w.argmax(axis=1)
        for k, i in enumerate(full):
            score = float(min(1.0, max(0.0, w[k, lead[k]])))
            out[first + i] = (model.languages[lead[k]], score, {model.languages[j]: float(w[k, j]) for j in np.flatnonzero(w[k] > 0)})
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, mixture`` of every whole text. The model's size is fixed by ``BUCKETS`` and the number of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = infer(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "lang_pred", "score", "mixture"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, mixture map<string,double>")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is known, with their own columns: rows predicted ``und`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([f[0] != NONE for f in infer(b.column(at).to_pylist(), shared.value)], pa.bool_()))

    return docs.mapInArrow(run, columns)
