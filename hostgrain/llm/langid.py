"""Language identification by a byte convolutional network.

Filters of several widths run over fixed-length windows of UTF-8 bytes; each filter's maximum over the window
feeds a softmax over the languages. The network is trained in numpy on a bounded sample of labelled rows and
then applied to every window of every text, in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16  # of each width
#: Windows that are scored at a time.
BATCH = 256
#: Probabilities are added up in whole units of this size, so that sums don't depend on order, and means given to DIGITS.
UNIT, DIGITS = 1e-9, 6
#: Bound of the training sample: documents of each language, and windows of each of them.
PER_LANG, PER_DOC = 1200, 4

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows_of(raw: bytes) -> np.ndarray:
    """The bytes as rows of WINDOW, the last filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class ByteNet:
    """weights[k]: (width, 256, FILTERS) of the k-th width, with its bias; dense: (filters, languages)."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.weights = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.offset = np.zeros(len(langs), np.float32)

    def _maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Per width the filters' responses at each position."""
        out = []
        for w, weight, bias in zip(WIDTHS, self.weights, self.bias, strict=True):
            n = x.shape[1] - w + 1
            out.append(sum(weight[j][x[:, j : j + n]] for j in range(w)) + bias)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on cross-entropy; the gradient of a maximum goes to the position that holds it."""
        rng = np.random.default_rng(seed)
        params = [*self.weights, *self.bias, self.dense, self.offset]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t, k = 0, len(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                maps = self._maps(xb)
                best = [a.argmax(1) for a in maps]
                pooled = np.concatenate([np.take_along_axis(a, b[:, None], 1)[:, 0] for a, b in zip(maps, best, strict=True)], 1)
                hidden = np.maximum(pooled, 0)
                p = _softmax(hidden @ self.dense + self.offset)
                p[np.arange(len(yb)), yb] -= 1
                p /= len(yb)
                back = (p @ self.dense.T) * (pooled > 0)
                grads = [np.zeros_like(w) for w in self.weights] + [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(k)] + [hidden.T @ p, p.sum(0)]
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        byte = np.take_along_axis(xb, best[i] + j, 1)
                        np.add.at(grads[i][j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), g)
                t += 1
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)

    def scorer(self):
        """A function from rows of windows to probabilities. Two neighbouring bytes are looked up at once. Nothing but
        element-wise operations, whose results don't depend on what else is in the batch, as those of a matrix product do."""
        pair = np.arange(65536)
        hi, lo = pair >> 8, pair & 255
        tables = []
        for w, weight in zip(WIDTHS, self.weights, strict=True):
            own = [(j, weight[j][hi] + weight[j + 1][lo]) for j in range(0, w - 1, 2)]
            if w % 2:
                own.append((w - 2, weight[w - 1][lo]))
            tables.append((w, own))

        def score(x: np.ndarray) -> np.ndarray:
            wide = x.astype(np.uint16)
            two = wide[:, :-1] << 8 | wide[:, 1:]
            pooled = []
            for (w, own), bias in zip(tables, self.bias, strict=True):
                n = x.shape[1] - w + 1
                total = None
                for j, t in own:
                    part = t.take(two[:, j : j + n], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(total.max(1) + bias)
            hidden = np.maximum(np.concatenate(pooled, 1), 0).astype(np.float64)
            z = np.tile(self.offset.astype(np.float64), (len(x), 1))
            for k, weight in enumerate(self.dense.astype(np.float64)):
                z += hidden[:, k, None] * weight
            return _softmax(z)

        return score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_language_net(labelled: DataFrame, per_lang: int = PER_LANG, per_doc: int = PER_DOC, id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet | None:
    """Fits the network on at most per_lang documents of each language, chosen by a hash of their id, and per_doc
    windows of each, spread over the whole text. Rows with a null lang or text, or no letter, teach nothing;
    None if nothing is left."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.md5(F.coalesce(F.col(id).cast("string"), F.lit("null"))).alias("_h"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    share = rows.groupBy("_lang").agg((F.lit(2.0 * per_lang) / F.count("*")).alias("_share"))
    drawn = rows.join(F.broadcast(share), "_lang").filter(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2**32 < F.col("_share"))
    picked = drawn.withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text"))).filter(F.col("_k") <= per_lang)

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, out = [], []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    w = windows_of(t.encode())
                    for k in sorted({int(i) for i in np.linspace(0, len(w) - 1, per_doc)}):
                        langs.append(name)
                        out.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    got = picked.select("_lang", "_text").mapInArrow(cut_windows, "lang string, window binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "window"], kind="stable")
    net = ByteNet(sorted(got["lang"].unique()))
    x = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    net.train(x, np.searchsorted(net.langs, got["lang"].to_numpy()))
    return net


def identify_language(docs: DataFrame, net: ByteNet | None, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, ``lang_pred`` and ``score`` of every row: the language with the
    highest mean probability over all windows of the whole text, weighted by their bytes, and that mean, to six digits.
    Equal texts have equal scores, whatever batch or partition they are in. Null texts and those without a
    letter are ``und`` with score 0, as is everything without a network. Repeated rows stay; an empty table gives an
    empty result."""
    src = docs.select(F.col(id).alias("doc_id"), *(F.col(c) for c in keep), F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net else None
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            total = np.zeros((len(texts), len(net.langs) if net else 1), np.int64)
            held, owner, n = [], [], 0  # windows, and of each its row and bytes

            def flush():
                x, who, share = np.concatenate(held), *np.concatenate(owner, 1)
                for at in range(0, len(x), BATCH):
                    np.add.at(total, who[at : at + BATCH], np.rint(score(x[at : at + BATCH]) / UNIT).astype(np.int64) * share[at : at + BATCH, None])

            known = [bool(net) and has_letter(t) for t in texts]
            count = np.ones(len(texts))
            for i, t in enumerate(texts):
                if not known[i]:
                    continue
                raw = t.encode()
                w = windows_of(raw)
                count[i] = len(raw)
                held.append(w)
                owner.append(np.array([np.full(len(w), i), np.minimum(WINDOW, len(raw) - WINDOW * np.arange(len(w)))]))
                n += len(w)
                if n >= 16 * BATCH:
                    flush()
                    held, owner, n = [], [], 0
            if held:
                flush()
            mean = np.round(total / count[:, None] * UNIT, DIGITS)
            best = total.argmax(1)
            pred = [net.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            value = [min(1.0, float(mean[i, k])) if known[i] else 0.0 for i, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(value, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    return src.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(id: str):
    """Documents that teach nothing: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
