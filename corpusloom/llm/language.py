"""Language ID: a bidirectional gated recurrent network over bytes.

Two small gated recurrent layers read a text's bytes, one from either end; every position gets a probability of each
language, and a document's probabilities are the mean over all its positions.  States go on through the whole text: windows are read side
by side, each after a run-up over the bytes before it, and a window whose run-up did not lead to the state in which its neighbour
ended is read again from that state, until it meets what stands.  The network is trained here, in numpy, by backpropagation through time over
windows and their run-ups, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_fold, documents, own_name, tidy

#: Units each way, labelled rows that the network is fitted on (the only bound; prediction reads whole texts), training steps.
UNITS, SAMPLE, STEPS, BATCH, RATE = 6, 2048, 200, 64, 0.02
#: Bytes in a window, bytes of run-up on either side of it, and by how much a state may miss the one it goes on from.
WINDOW, RUN_UP, MISS = 256, 32, 0.01
#: Windows that are run together, and the byte that fills up the ends of a text (no UTF-8 text holds it; states stay as they are on it).
BLOCK, PAD = 2048, 255
UNDEFINED = "und"


def _soft(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``x / (1 + |x|)`` in place, with room for as much again: the squashing function of gates and candidates, whose slope is ``(1 - |y|) ** 2``."""
    np.abs(x, out=room)
    room += 1
    x /= room
    return x


class ByteGru:
    """Parameters: for each direction a table of gate inputs by byte and a recurrent matrix; then the output layer.

    Gates lie in rows (update, reset, candidate), windows in columns.
    """

    def __init__(self, langs: list[str], units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.units = langs, units
        shapes = {"in0": (3 * units, PAD + 1), "in1": (3 * units, PAD + 1), "rec0": (3 * units, units), "rec1": (3 * units, units), "out": (len(langs), 2 * units), "bias": (len(langs), 1)}
        self.p = {k: (rng.standard_normal(s) * (0.0 if k == "bias" else 0.3)).astype(np.float32) for k, s in shapes.items()}
        for table in (self.p["in0"], self.p["in1"]):
            table[:units, PAD] = 1e12  # an update gate of 1 and a slope of 0: training leaves it so

    def _read(self, codes: np.ndarray, way: int, h: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """States of one direction at every position, from ``h`` or from zero: (positions, units, windows)."""
        u = self.units
        table, rec = self.p[f"in{way}"], self.p[f"rec{way}"]
        steps, n = codes.shape
        states = np.empty((steps, u, n), rec.dtype)
        if h is None:
            h = np.zeros((u, n), rec.dtype)
        a, s, room, c = (np.empty((k * u, n), rec.dtype) for k in (3, 3, 2, 1))
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            if keep is not None:  # else the same arrays serve all positions
                a, s, c = np.empty_like(a), np.empty_like(s), np.empty_like(c)
            table.take(codes[t], 1, a, "clip")
            np.matmul(rec, h, out=s)
            gates = a[: 2 * u]
            gates += s[: 2 * u]
            _soft(gates, room)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:u], gates[u:]
            np.multiply(r, s[2 * u :], out=c)
            c += a[2 * u :]
            _soft(c, room[:u])
            new = states[t]
            np.subtract(h, c, out=new)
            new *= z
            new += c
            if keep is not None:
                keep.append((t, h, z, r, c, s[2 * u :]))
            h = new
        return states

    def _carried(self, codes: np.ndarray, of: np.ndarray, way: int, before: np.ndarray | None = None) -> np.ndarray:
        """States of one direction at every position of windows that lie in the order of their texts, as if each text was read in one go but for ``MISS``.

        ``before`` is the state in which the window beyond these (before the first, or after the last) ended, if it is of the same text.
        """
        whole = self._read(codes[: RUN_UP + WINDOW] if way == 0 else codes[RUN_UP:], way)
        states, began = (whole[RUN_UP:], whole[RUN_UP - 1].copy()) if way == 0 else (whole[:WINDOW], whole[WINDOW].copy())
        core, (step, end, edge) = codes[RUN_UP : RUN_UP + WINDOW], (1, -1, 0) if way == 0 else (-1, 0, -1)
        goes_on = np.roll(of, step) == of
        goes_on[edge] = before is not None
        while True:
            ended = np.roll(states[end], step, 1)
            if before is not None:
                ended[:, edge] = before
            off = np.flatnonzero(goes_on & (np.abs(ended - began).max(0) > MISS))
            if not len(off):
                return states
            h = began[:, off] = ended[:, off]
            for at in range(0, WINDOW, RUN_UP) if way == 0 else range(WINDOW - RUN_UP, -1, -RUN_UP):
                new, held = self._read(core[at : at + RUN_UP, off], way, h), states[at : at + RUN_UP]
                apart = np.abs(new[end] - held[end][:, off]).max(0) > MISS  # where they have met again, the rest of the window stands
                held[:, :, off] = new
                h, off = new[end][:, apart], off[apart]
                if not len(off):
                    break

    def positions(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All windows of all texts, block by block: text of each window, codes (positions, windows), probabilities (positions, languages, windows)."""
        frames, of = windows(texts)
        cuts = blocks(of)
        linked = [of[at] == of[at - 1] for at in cuts[1:-1]] + [False]
        # of a text of several blocks, what lies behind a block is read first
        behind: dict[int, np.ndarray] = {}
        for k in range(len(linked) - 2, -1, -1):
            if linked[k]:
                at, to = cuts[k + 1], cuts[k + 2]
                behind[k] = self._carried(np.ascontiguousarray(frames[at:to].T), of[at:to], 1, behind.get(k + 1))[0, :, 0].copy()
        before, split = None, self.units
        for k, (at, to) in enumerate(zip(cuts, cuts[1:])):
            codes = np.ascontiguousarray(frames[at:to].T)
            there, back = self._carried(codes, of[at:to], 0, before), self._carried(codes, of[at:to], 1, behind.get(k))
            before = there[-1, :, -1].copy() if linked[k] else None
            logits = np.matmul(self.p["out"][:, :split], there) + np.matmul(self.p["out"][:, split:], back) + self.p["bias"]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            yield of[at:to], codes[RUN_UP : RUN_UP + WINDOW], logits

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions of windows that are no padding; run-ups do not count themselves."""
        u = self.units
        steps, n = codes.shape
        kept: tuple[list, list] = ([], [])
        states = [self._read(codes, way, keep=kept[way]) for way in (0, 1)]
        both = np.concatenate(states, 1)
        logits = np.matmul(self.p["out"], both) + self.p["bias"]
        logits -= logits.max(1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(1, keepdims=True)
        prob[:, target, np.arange(n)] -= 1
        counts = codes != PAD
        counts[:RUN_UP] = counts[RUN_UP + WINDOW :] = False
        prob *= (counts / max(1, counts.sum())).astype(prob.dtype)[:, None, :]
        grads = {"out": np.einsum("tln,tun->lu", prob, both, optimize=True), "bias": prob.sum((0, 2))[:, None]}
        down = np.matmul(self.p["out"].T, prob)
        for way in (0, 1):
            rec = self.p[f"rec{way}"]
            grad_rec, inputs = np.zeros_like(rec), np.empty((steps, 3 * u, n), rec.dtype)
            dh = np.zeros((u, n), rec.dtype)
            for t, before, z, r, c, s in reversed(kept[way]):
                dh = dh + down[t, way * u : (way + 1) * u]
                dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
                # a gate g is (1 + y) / 2 of a squashed y, so its slope is (1 - |2g - 1|) ** 2 / 2
                dz, dr = dh * (before - c) * (1 - np.abs(2 * z - 1)) ** 2 / 2, dc * s * (1 - np.abs(2 * r - 1)) ** 2 / 2
                ds = np.concatenate([dz, dr, dc * r])
                inputs[t] = np.concatenate([dz, dr, dc])
                grad_rec += ds @ before.T
                dh = dh * z + rec.T @ ds
            flat, per_row = codes.ravel(), inputs.transpose(1, 0, 2).reshape(3 * u, -1)
            grads[f"in{way}"] = np.stack([np.bincount(flat, row, PAD + 1) for row in per_row])
            grads[f"rec{way}"] = grad_rec
        return grads

    def fit(self, codes: np.ndarray, target: np.ndarray, of: np.ndarray, steps: int = STEPS, seed: int = 7) -> ByteGru:
        """Adam over batches of windows with their run-ups (windows, positions) of the texts ``of``: a text is drawn first, then one of its windows."""
        rng = np.random.default_rng(seed)
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        count = np.diff(np.r_[begin, len(of)])
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            text = rng.integers(0, len(begin), BATCH)
            pick = begin[text] + rng.integers(0, count[text])
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in self.gradients(np.ascontiguousarray(codes[pick].T), target[pick]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each whole text: (texts, languages); zeros for an empty one."""
        total = np.zeros((len(texts), len(self.langs)))
        for doc, codes, prob in self.positions(texts):
            each = np.einsum("tln,tn->ln", prob, (codes != PAD).astype(prob.dtype))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc, each[k], len(texts))
        return total / np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)[:, None]

    def labels(self, text: bytes) -> np.ndarray:
        """The index of the likeliest language at every byte of a text."""
        each = [prob.argmax(1).T.ravel() for _, _, prob in self.positions([text])]
        return np.concatenate(each)[: len(text)] if each else np.zeros(0, np.int64)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts with their run-ups (windows, positions), as views, and the text of each; a text of no bytes has none."""
    edge, pad = bytes([PAD]) * RUN_UP, bytes([PAD])
    codes = np.frombuffer(b"".join([edge + x + pad * (-len(x) % WINDOW) + edge for x in texts if x]), np.uint8)
    count = np.fromiter((-(-len(x) // WINDOW) for x in texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), count)
    if not len(of):
        return np.zeros((0, WINDOW + 2 * RUN_UP), np.uint8), of
    # texts before a window add their own two edges to its place
    begin = np.arange(len(of)) * WINDOW + 2 * RUN_UP * (np.cumsum(count > 0) - 1)[of]
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW + 2 * RUN_UP)[begin], of


def blocks(of: np.ndarray) -> list[int]:
    """Where blocks of at most ``BLOCK`` windows begin, and the end: texts stay whole, but for those that fill more than a block themselves."""
    if not len(of):
        return [0]
    ends = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) + 1
    cuts, at = [0], 0
    while at < len(of):
        k = np.searchsorted(ends, at + BLOCK, "right")
        whole = ends[k - 1] if k and ends[k - 1] > at else 0
        at = int(whole) or min(at + BLOCK, len(of))
        cuts.append(at)
    return cuts


def train(docs: DataFrame, sample: int = SAMPLE) -> ByteGru | None:
    """Fit on the whole texts of about ``sample`` rows with a language, those whose hash of id, language and text is small enough for that share of
    the rows; each text counts as much, whatever its length.  None if there is no such row.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    n = labelled.count()
    if not n:
        return None
    # the limit in numbers of 31 bits is set by the count, so that the rows that reach the driver do not grow with it
    h = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "lang", "text"), F.lit(1 << 31))
    rows = labelled.where(h <= min((1 << 31) - 1, (sample << 31) // n)).select("lang", "text").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], r["text"].encode("utf-8", "surrogatepass")) for r in rows)
    langs = sorted({lang for lang, _ in rows})
    texts = [x for _, x in rows]
    codes, of = windows(texts)
    return ByteGru(langs).fit(codes, np.array([langs.index(lang) for lang, _ in rows])[of], of)


def predict(docs: DataFrame, model: ByteGru | None, text_col: str = "text", col: str = "language") -> DataFrame:
    """``docs`` with a struct ``lang_pred, score`` from whole texts.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if the model is None.  Each row is
    judged by its text alone; an empty table gives an empty result; other columns pass through untouched.
    """

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            plain = [x if x and model and any(map(str.isalpha, x)) else "" for x in texts]
            if not model:
                yield pd.DataFrame({"lang_pred": [UNDEFINED] * len(plain), "score": 0.0})
                continue
            prob = model.pooled([x.encode("utf-8", "surrogatepass") for x in plain])
            best = prob.argmax(1) if len(plain) else np.zeros(0, int)
            yield pd.DataFrame({"lang_pred": [model.langs[b] if x else UNDEFINED for b, x in zip(best, plain)], "score": np.clip(prob[np.arange(len(plain)), best], 0, 1)})

    return docs.withColumn(col, run(F.col(text_col)))


def label_positions(docs: DataFrame, model: ByteGru, text_col: str = "text", col: str = "runs") -> DataFrame:
    """``docs`` with the runs of equal labels over a text's bytes: ``array<struct<start, length, lang>>``."""

    @F.pandas_udf("array<struct<start: int, length: int, lang: string>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            label = model.labels((x or "").encode("utf-8", "surrogatepass"))
            cuts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.zeros(0, int)
            sizes = np.diff(np.r_[cuts, len(label)])
            out.append([{"start": int(a), "length": int(n), "lang": model.langs[label[a]]} for a, n in zip(cuts, sizes)])
        return pd.Series(out)

    return docs.withColumn(col, run(F.col(text_col)))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (doc_fold(F.col("doc_id")) == 0).alias("held_out"))
    model = train(docs.where("NOT held_out"))
    col = own_name(docs, "language")
    return predict(docs.drop("lang"), model, col=col).select("doc_id", "held_out", f"{col}.*")
