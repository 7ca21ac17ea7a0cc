"""Toxicity scores by a convolutional text classifier trained in numpy.

A text is the sequence of its words (runs of letters, in lower case). A word's
embedding is the sum of two rows of a hashed table, so that words rarely share
both. Filters of several widths run over the sequence, each keeps its largest
response anywhere in the text, and a logistic layer turns these into a score.
Whole texts are scored; the score sees nothing but the text.

Training takes at most ``TRAIN_ROWS`` labelled rows of each class, those with
the smallest hash of their id, and of these as many as have ``TRAIN_WORDS`` words
together. A part of them is kept back to set where the score crosses 0.5, and a
threshold for each language. Training runs on the driver, on hashed words; only
the sample, bounded in rows and words, reaches it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrowtext import blocks, distinct, give_back, map_arrow

#: Labelled rows of each class that training takes at most, and their words.
TRAIN_ROWS, TRAIN_WORDS = 3000, 4_000_000
BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PAD = max(WIDTHS) - 1
STEPS, BATCH, RATE, DECAY = 3000, 32, 0.1, 1e-5
#: Of so many rows of the sample one is kept back.
KEPT_BACK = 8
#: Rows of a language that a threshold of its own takes at least, of each class, among those kept back.
LANGUAGE_ROWS = 8

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The index of each word, the different words, and each text's first word (n + 1 entries)."""
    letter = _LETTER[data] if len(data) else np.zeros(0, bool)
    if not letter.any():
        return np.zeros(0, np.int64), [], np.zeros(len(offsets), np.int64)
    before = np.insert(letter[:-1], 0, False)
    mark = letter & ~before
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    mark[begins] |= letter[begins]
    lower = _LOWER[data]
    capital = (np.insert(data[:-1], 0, 0) == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    lower[capital] += 0x20
    ends = np.concatenate([[0], np.cumsum(letter)])[offsets]
    first = np.flatnonzero(mark[letter])
    index, words = distinct(lower[letter], np.append(first, int(letter.sum())))
    return index, words, np.searchsorted(first, ends)


def buckets(words: list[bytes]) -> np.ndarray:
    """Two table rows for each word; row 0 of the table is that of padding."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    a = h % np.uint64(BUCKETS - 1) + np.uint64(1)
    b = (h >> np.uint64(32)) % np.uint64(BUCKETS) + np.uint64(BUCKETS)
    return np.stack([a, b], 1).astype(np.int64)


class Model:
    """Weights, and the forward pass over hashed words."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        self.table = g.normal(0, 0.02, (2 * BUCKETS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.filters = [[g.normal(0, 0.5 / w, (DIM, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = [np.full(FILTERS, 0.02, np.float32) for _ in WIDTHS]
        self.out = g.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.intercept = 0.0
        self.thresholds: dict[str, float] = {}

    def pooled(self, embedding: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text; 0 where a text has no word.

        ``embedding`` has a row for each different word, ``index`` names them.
        """
        n = np.diff(first)
        out = np.zeros((len(n), len(WIDTHS) * FILTERS), np.float32)
        full = np.flatnonzero(n)
        if not len(full):
            return out
        begin = first[full]
        last = np.zeros(len(index) + PAD, bool)
        for k, (width, taps, bias) in enumerate(zip(WIDTHS, self.filters, self.bias, strict=True)):
            response = (embedding @ taps[0])[index]
            for j in range(1, width):
                tap = (embedding @ taps[j])[index]
                # word i + j counts for the window at i unless it belongs to a later text
                last[:] = False
                for back in range(j):
                    last[np.maximum(first[1:][n > 0] - 1 - back, 0)] = True
                tap[: len(tap) - j] = tap[j:]
                tap[last[: len(index)]] = 0
                response += tap
            top = np.maximum.reduceat(response, begin, axis=0) + bias
            out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top, 0)
        return out

    def logits(self, words: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        embedding = self.table[words[:, 0]] + self.table[words[:, 1]] if len(words) else np.zeros((0, DIM), np.float32)
        return self.pooled(embedding, index, first) @ self.out + self.intercept

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Stochastic gradient descent with step sizes by past gradients; ``texts`` hold two table rows a word."""
        g = np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
        sums = {"table": np.full(len(self.table), 1e-4, np.float32), "out": np.full_like(self.out, 1e-4), "intercept": 1e-4,
                "bias": [np.full_like(b, 1e-4) for b in self.bias], "filters": [[np.full_like(t, 1e-4) for t in f] for f in self.filters]}
        order = np.flatnonzero([len(t) > 0 for t in texts])
        for _ in range(-(-STEPS * BATCH // max(1, len(order)))):
            g.shuffle(order)
            for at in range(0, len(order), BATCH):
                self._step([texts[i] for i in order[at : at + BATCH]], labels[order[at : at + BATCH]], weight[order[at : at + BATCH]], sums)

    def _step(self, texts, labels, weight, sums) -> None:
        n = np.array([len(t) for t in texts])
        rows = np.concatenate([x for t in texts for x in (t, np.zeros((PAD, 2), t.dtype))])
        begin = np.cumsum(n + PAD) - (n + PAD)
        e = self.table[rows[:, 0]] + self.table[rows[:, 1]]
        e[(rows[:, 0] == 0)] = 0
        pooled, places = [], []
        for width, taps, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            response = e @ taps[0]
            for j in range(1, width):
                response[:-j] += e[j:] @ taps[j]
            place = np.stack([b + response[b : b + k].argmax(0) for b, k in zip(begin, n, strict=True)])
            places.append(place)
            pooled.append(np.take_along_axis(response, place, 0) + bias)
        raw = np.concatenate(pooled, 1)
        active = raw > 0
        h = np.where(active, raw, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.intercept, -30, 30)))
        d = ((p - labels) * weight / len(texts)).astype(np.float32)
        dh = d[:, None] * self.out * active
        grad_rows, grad_values = [], []
        for k, (width, place) in enumerate(zip(WIDTHS, places, strict=True)):
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(width):
                near = e[place + j]  # texts x filters x DIM
                taps = self.filters[k][j]
                grad_rows.append((place + j).ravel())
                grad_values.append((dk[:, :, None] * taps.T[None]).reshape(-1, DIM))
                self._move(taps, np.einsum("tf,tfd->df", dk, near) + DECAY * taps, sums["filters"][k][j])
            self._move(self.bias[k], dk.sum(0), sums["bias"][k])
        self._move(self.out, h.T @ d + DECAY * self.out, sums["out"])
        total = float(d.sum())
        sums["intercept"] += total**2
        self.intercept -= RATE * total / sums["intercept"] ** 0.5
        at, values = np.concatenate(grad_rows), np.concatenate(grad_values)
        real = rows[at, 0] > 0
        at, values = rows[at[real]], values[real]
        both = np.concatenate([at[:, 0], at[:, 1]])
        uniq, inverse = np.unique(both, return_inverse=True)
        summed = np.zeros((len(uniq), DIM), np.float32)
        np.add.at(summed, inverse, np.concatenate([values, values]))
        sums["table"][uniq] += (summed**2).mean(1)
        self.table[uniq] -= RATE * summed / np.sqrt(sums["table"][uniq])[:, None]

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, lang: list[str | None]) -> None:
        """Where the score crosses 0.5, from rows that the model has not seen; then a threshold for each language that has enough."""
        shift = best_cut(logits, labels, weight)
        self.intercept -= shift
        logits = logits - shift
        for name in sorted({x for x in lang if x is not None}):
            own = np.array([i for i, x in enumerate(lang) if x == name], np.int64)
            if min(labels[own].sum(), (1 - labels[own]).sum()) >= LANGUAGE_ROWS:
                self.thresholds[name] = float(1 / (1 + np.exp(-best_cut(logits[own], labels[own], weight[own], 0.0))))

    @staticmethod
    def _move(weights, grad, total) -> None:
        total += grad**2
        weights -= RATE * grad / np.sqrt(total)


def best_cut(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray, near: float | None = None) -> float:
    """The logit between two rows that divides the classes with the least weighted error.

    Of equally good ones, the closest to ``near`` or else the middle one.
    """
    order = np.argsort(logits)
    z, y, w = logits[order], labels[order], weight[order]
    missed = np.concatenate([[0.0], np.cumsum(w * (y == 1))])
    false = np.concatenate([[0.0], np.cumsum((w * (y == 0))[::-1])])[::-1]
    error = missed + false
    error[1:-1][z[1:] == z[:-1]] = np.inf
    ties = np.flatnonzero(error <= error.min() + 1e-12)
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(cuts[ties[len(ties) // 2] if near is None else ties[np.argmin(np.abs(cuts[ties] - near))]])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """A model from the rows of ``labels (doc_id, toxic)`` whose crc32(id) mod 5 is not 0.

    Null labels and labels of absent documents teach nothing; texts are taken
    whole. Without rows of both classes the model scores every text 0 (or 1 if
    all rows are toxic).
    """
    own = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = own.where("toxic = 1").orderBy(*order).limit(train_rows).unionByName(own.where("toxic = 0").orderBy(*order).limit(train_rows))
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string").alias("lang"))
    chosen = held.join(F.broadcast(sample), "doc_id")  # 2 * train_rows rows at most

    def work(batches):
        for rows, data, offsets in blocks(batches):
            index, words, first = hashed_words(data, offsets)
            at = buckets(words)[index] if len(words) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index(c)) for c in ("doc_id", "toxic", "lang")]
                + [pa.array([at[first[i] : first[i + 1]].astype("<i4").tobytes() for i in range(rows.num_rows)], pa.binary())],
                ["doc_id", "toxic", "lang", "words"],
            )

    kinds = dict(chosen.dtypes)
    found = map_arrow(chosen, work, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, lang string, words binary")
    rank = [F.xxhash64("doc_id", F.lit(1)), F.col("doc_id"), F.xxhash64("words")]
    upto = Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the sample only
    found = found.withColumn("upto", F.sum(F.octet_length("words") / 8).over(upto)).where(F.col("upto") <= TRAIN_WORDS).orderBy("upto", *rank).drop("upto").toArrow()
    texts = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in found["words"].to_pylist()]
    y = np.array(found["toxic"].to_pylist(), np.int64)
    lang = found["lang"].to_pylist()
    del found
    model = Model()
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        model.intercept = 8.0 if len(y) and y.min() == 1 else -8.0
        return model
    n_of = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    back = np.arange(len(y)) % KEPT_BACK == KEPT_BACK - 1
    learn = np.flatnonzero(~back) if len(y) >= 50 else np.arange(len(y))
    model.fit([texts[i] for i in learn], y[learn])
    if len(y) >= 50:
        weight = np.where(y == 1, n_of[1] / max(1, (y == 1).sum()), n_of[0] / max(1, (y == 0).sum()))
        test = np.flatnonzero(back)
        if 0 < y[test].sum() < len(test):
            z = np.array([model.logits(texts[i], np.arange(len(texts[i])), np.array([0, len(texts[i])]))[0] for i in test])
            model.calibrate(z, y[test], weight[test], [lang[i] for i in test])
    give_back()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``score, predicted, threshold, rejected`` added.

    ``predicted`` is 1 from a score of 0.5 on; ``rejected`` compares the score
    with the threshold calibrated for the row's language, 0.5 where there is
    none. Null and empty texts are scored as texts without words, texts of any
    length whole, equal texts alike, and repeated rows each for itself. Columns
    of ``docs`` by the added names are replaced, all others kept. An empty table
    gives an empty result.
    """
    docs = docs.drop("score", "predicted", "threshold", "rejected")
    ids, kinds = docs.columns, dict(docs.dtypes)

    def work(batches):
        for rows, data, offsets in blocks(batches, text_col):
            index, words, first = hashed_words(data, offsets)
            z = model.logits(buckets(words), index, first).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            lang = rows.column(rows.schema.get_field_index(lang_col)).to_pylist() if lang_col in ids else [None] * len(p)
            cut = np.array([model.thresholds.get(x, 0.5) for x in lang])
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(cut), pa.array(p >= cut)],
                [*ids, "score", "predicted", "threshold", "rejected"],
            )

    added = "score double, predicted int, threshold double, rejected boolean"
    return map_arrow(docs, work, ", ".join(f"`{c}` {kinds[c]}" for c in ids) + ", " + added)
