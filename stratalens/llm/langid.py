"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained in numpy: gated recurrent units run over a window of bytes in
both directions, every position gets a probability of each language, and a document's probability
is the mean over all its positions. Training is backpropagation through time on windows from a
bounded sample of labelled rows (``SAMPLE`` rows by hash order, a documented parameter), drawn where
the texts are: ``DRAWN`` windows at random places of each whole text, so the driver sees the same
amount at any size. Prediction reads every byte of every text, in windows of fixed length that make
up large batches. It is a map without a shuffle; the weights (a few kilobytes) travel in the closure.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without a labelled
row everything is ``und``; ties go to the first language in order; repeated rows are predicted
alike; columns of the input other than the outputs are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

#: Labelled rows that training reads at most, and windows drawn from each.
SAMPLE, DRAWN = 3000, 4
#: Units in each direction, bytes in a window, windows in a batch.
UNITS, WINDOW, BATCH = 8, 64, 2048
LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x):
    import numpy as np

    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Parameters by name: ``e`` gate inputs of each byte (256, 3H), ``u`` recurrent weights
    (H, 3H), for both directions; ``v`` and ``c`` the output layer."""

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(units)).astype(np.float32)
        self.p = {"v": small(2 * units, len(labels)), "c": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"e{d}": small(256, 3 * units), f"u{d}": small(units, 3 * units)}

    def run(self, x, keep: bool = False):
        """States (T, B, 2H) for bytes x (T, B), and what the backward pass needs."""
        import numpy as np

        steps, batch = x.shape
        n = self.units
        out = np.empty((steps, batch, 2 * n), np.float32)
        tape = {}
        for k, d in enumerate("fb"):
            e, u = self.p[f"e{d}"], self.p[f"u{d}"]
            h = np.zeros((batch, n), np.float32)
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                g = e.take(x[t], axis=0)
                q = h @ u
                gates = _sigmoid(g[:, : 2 * n] + q[:, : 2 * n])
                z, r = gates[:, :n], gates[:, n:]
                new = np.tanh(g[:, 2 * n :] + r * q[:, 2 * n :])
                if keep:
                    tape[d, t] = (h, z, r, new, q[:, 2 * n :])
                h = new + z * (h - new)
                out[t, :, k * n : (k + 1) * n] = h
        return out, tape

    def probabilities(self, states):
        import numpy as np

        s = states @ self.p["v"] + self.p["c"]
        s = np.exp(s - s.max(-1, keepdims=True))
        return s / s.sum(-1, keepdims=True)

    def gradients(self, x, y):
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        import numpy as np

        steps, batch = x.shape
        n = self.units
        states, tape = self.run(x, keep=True)
        p = self.probabilities(states)
        loss = -np.log(p[:, np.arange(batch), y] + 1e-9).mean()
        d_score = p.copy()
        d_score[:, np.arange(batch), y] -= 1
        d_score /= steps * batch
        grad = {"v": np.einsum("tbi,tbj->ij", states, d_score), "c": d_score.sum((0, 1))}
        d_states = d_score @ self.p["v"].T
        for k, d in enumerate("fb"):
            u = self.p[f"u{d}"]
            du, de = np.zeros_like(u), np.zeros_like(self.p[f"e{d}"])
            back = np.zeros((batch, n), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, z, r, new, qn = tape[d, t]
                dh = back + d_states[t, :, k * n : (k + 1) * n]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * qn * r * (1 - r)
                dg = np.concatenate([d_z, d_r, d_new], 1)
                dq = np.concatenate([d_z, d_r, d_new * r], 1)
                np.add.at(de, x[t], dg)
                du += h.T @ dq
                back = dh * z + dq @ u.T
            grad |= {f"u{d}": du, f"e{d}": de}
        return loss, grad

    def train(self, windows, targets, steps: int = 150, batch: int = 256, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam on random batches of windows (N, T); returns the losses."""
        import numpy as np

        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(windows), batch)
            loss, grad = self.gradients(windows[rows].T, targets[rows])
            losses.append(float(loss))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, data, offsets, positions: bool = False):
        """Mean probabilities of each text of a batch; on request the label of every byte as well."""
        import numpy as np

        size = np.diff(offsets)
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), count)
        first = np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        start = offsets[doc] + (np.arange(len(doc)) - first) * WINDOW
        total = np.zeros((len(size), len(self.labels)))
        labels = np.zeros(len(data), np.uint8)
        for k in range(0, len(doc), BATCH):
            at = start[k : k + BATCH, None] + np.arange(WINDOW)
            inside = at < offsets[doc[k : k + BATCH] + 1][:, None]
            x = np.where(inside, data[np.minimum(at, len(data) - 1)], 32).T
            p = self.probabilities(self.run(np.ascontiguousarray(x))[0])
            if positions:
                labels[at[inside]] = p.argmax(-1).T[inside]
            np.add.at(total, doc[k : k + BATCH], (p * inside.T[:, :, None]).sum(0))
        return total / np.maximum(size, 1)[:, None], labels


def training_rows(docs: DataFrame, sample: int = SAMPLE, drawn: int = DRAWN) -> list[tuple[bytes, str]]:
    """The bounded sample, (window, language): of the ``sample`` first rows by a hash of the id, outside
    the held-out fold, ``drawn`` windows of WINDOW bytes that start at random places of the whole text."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    # a share of the hashes holds the sample at any size, so that partitions do not send as many ids each
    order, n = F.xxhash64("doc_id"), rows.count()
    share = min(1.0, 1.5 * sample / n + 100 / n) if n else 1.0
    some = rows if share == 1 else rows.filter(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40)))
    picked = some.select(order.alias("o"), "doc_id").distinct().orderBy("o", "doc_id").limit(sample).select("doc_id")
    raw = F.encode("text", "utf-8")
    start = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(31), i), F.greatest(F.octet_length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1
    windows = F.transform(F.sequence(F.lit(1), F.lit(drawn)), lambda i: F.substring(F.col("raw"), start(i), F.lit(WINDOW)))
    # at most ``sample`` ids: the side that is broadcast is bounded by the parameter
    found = some.filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id").withColumn("raw", raw).select("doc_id", "lang", windows.alias("w"))
    return [(bytes(w), r.lang) for r in sorted(found.collect(), key=lambda r: (r.doc_id, r.lang, r.w)) for w in r.w]


def learn(rows: list[tuple[bytes, str]], steps: int = 150, seed: int = 5) -> BiGru | None:
    """Trains on windows (longer texts are cut at random), the same number for each language."""
    import numpy as np

    labels = sorted({lang for _, lang in rows})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    windows, targets = [], []
    for y, lang in enumerate(labels):
        texts = [t for t, own in rows if own == lang]
        order = rng.permutation(len(texts))
        for k in range(1500):
            t = texts[order[k % len(texts)]]
            at = int(rng.integers(0, max(1, len(t) - WINDOW // 2))) if len(t) > WINDOW else 0
            windows.append(np.frombuffer(t[at : at + WINDOW].ljust(WINDOW), np.uint8))
            targets.append(y)
    net = BiGru(labels)
    net.train(np.stack(windows), np.array(targets), steps)
    return net


def predict(docs: DataFrame, net: BiGru | None, text: str = "text", positions: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score``; with ``positions`` also ``byte_labels``, one byte for each
    byte of the text: the index of its language in order."""
    made = [("lang_pred", T.StringType()), ("score", T.DoubleType())] + [("byte_labels", T.BinaryType())] * positions
    kept = [c for c in docs.columns if c.lower() not in {n for n, _ in made} or c == text]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in made]])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .bytehash import bytes_of, slices

        for whole in batches:
            for batch in slices(whole, at, 1 << 20):
                data, offsets = bytes_of(batch.column(at))
                known = [bool(t and net and LETTER.search(t)) for t in batch.column(at).to_pylist()]
                labels = np.zeros(0, np.uint8)
                if any(known):
                    p, labels = net.documents(data, offsets, positions)
                    best = p.argmax(1)
                else:
                    p, best = np.zeros((batch.num_rows, 1)), np.zeros(batch.num_rows, int)
                langs = [net.labels[b] if k else "und" for b, k in zip(best, known, strict=True)]
                scores = [min(1.0, float(p[i, b])) if known[i] else 0.0 for i, b in enumerate(best)]
                extra = [pa.array([labels[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())] if positions else []
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *extra], names=schema.names)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents")
    net = learn(training_rows(docs.select("doc_id", "text", "lang")))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
