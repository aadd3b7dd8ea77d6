"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads all bytes of a text (letters, with one space for whatever stands between) forwards and backwards,
gives every position a probability of each language, and a document the mean over its positions. Texts are
read in sequences of bounded length; each also reads the bytes that stand before and after it, so that its states at
its own positions carry over words and over the cuts. It is trained in numpy by backpropagation through time
on windows from all over a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.rows import quoted, unused
from loomspark.llm.scratch import alone

HIDDEN = 12
#: Documents of a language that are trained on, about, and windows of each, evenly spaced over its whole text.
SAMPLE, PIECES = 400, 32
#: Bytes of a window, windows that are trained on, and passes over them.
WINDOW, WINDOWS, PASSES = 64, 16_000, 3
#: Bytes of a sequence, and bytes that it reads before and after them (spaces beyond the text).
SEQUENCE, MARGIN = 512, 32
#: Bytes of texts that are read at once.
BLOCK = 1 << 19
UNKNOWN = "und"
#: Mean probability of the likeliest language under which `identified` takes a text for one of no language.
SURE = 0.4

#: Letters: A-Z lower-cased, a-z and bytes of other scripts; all else to space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """The bytes that the network reads."""
    return b" ".join(text.encode().translate(_LETTERS).split())


def _lettered(text: str | None) -> bool:
    """Whether a text has a letter; numbers of any kind are none."""
    return bool(text) and any(map(str.isalpha, text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights by name. `x` holds for each direction the input part of the update, reset and candidate
    gates by byte, `u` their recurrent part; `o` and `b` map both states of a position to languages."""

    def __init__(self, languages: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden, self.languages = hidden, languages
        scale = 1 / np.sqrt(hidden)
        self.weights = {"o": rng.normal(0, scale, (2 * hidden, languages)).astype(np.float32), "b": np.zeros(languages, np.float32)}
        for way in "fb":
            self.weights["x" + way] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.weights["u" + way] = rng.normal(0, scale, (hidden, 3 * hidden)).astype(np.float32)

    def _run(self, data: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (position, sequence, unit) of sequences of equal length (sequence, position)."""
        n, h = self.hidden, np.zeros((len(data), self.hidden), np.float32)
        x, u = self.weights["x" + way], self.weights["u" + way]
        order = range(data.shape[1]) if way == "f" else range(data.shape[1] - 1, -1, -1)
        states = np.empty((data.shape[1], *h.shape), np.float32)
        for t in order:
            a, r = x[data[:, t]], h @ u
            gates = _sigmoid(a[:, : 2 * n] + r[:, : 2 * n])
            update, reset = gates[:, :n], gates[:, n:]
            candidate = np.tanh(a[:, 2 * n :] + reset * r[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, update, reset, candidate, r[:, 2 * n :]))
            h = h + update * (candidate - h)
            states[t] = h
        return states

    def _scores(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        s = np.concatenate([forward, backward], axis=2) @ self.weights["o"] + self.weights["b"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True)

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(position, sequence, language)."""
        return self._scores(self._run(data, "f"), self._run(data, "b"))

    def pooled(self, data: np.ndarray, own: np.ndarray, margin: int) -> np.ndarray:
        """Sums of the probabilities (sequence, language) over the positions `margin` to margin + own of each sequence. data:
        (position, sequence), sequences by descending `own`; each is read to margin + own + margin."""
        n, o, bias = self.hidden, self.weights["o"].T.copy(), self.weights["b"][:, None]
        half = np.empty((len(data), self.languages, len(own)), np.float32)
        sums = np.zeros((self.languages, len(own)))
        active = np.searchsorted(-own, 2 * margin - np.arange(len(data)), "left")  # own + 2 margin > position
        counted = np.searchsorted(-own, margin - np.arange(len(data)), "left")
        for way in "fb":
            x, u, h = self.weights["x" + way].T.copy(), self.weights["u" + way].T.copy(), np.zeros((n, len(own)), np.float32)
            mine = o[:, :n] if way == "f" else o[:, n:]
            for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
                k = active[t]
                now = h[:, :k]
                a, r = x.take(data[t, :k], axis=1, mode="clip"), u @ now
                gates, candidate = a[: 2 * n], r[2 * n :]
                gates += r[: 2 * n]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                candidate *= gates[n:]
                candidate += a[2 * n :]
                np.tanh(candidate, out=candidate)
                candidate -= now
                candidate *= gates[:n]
                now += candidate
                if way == "f":
                    half[t, :, :k] = mine @ now
                elif t >= margin and (m := counted[t]):
                    s = mine @ now[:, :m]
                    s += half[t, :, :m]
                    s += bias
                    np.exp(s, out=s)
                    s /= s.sum(axis=0)
                    sums[:, :m] += s
        return sums.T

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean cross entropy over all positions, by backpropagation through time; and that mean."""
        kept = {"f": [], "b": []}
        states = {way: self._run(data, way, kept[way]) for way in "fb"}
        p = self._scores(states["f"], states["b"])
        size, n = p.shape[0] * p.shape[1], self.hidden
        loss = -float(np.log(p[:, np.arange(len(label)), label] + 1e-12).mean())
        p[:, np.arange(len(label)), label] -= 1
        p /= size
        both = np.concatenate([states["f"], states["b"]], axis=2)
        grads = {"o": np.einsum("tbi,tbj->ij", both, p), "b": p.sum(axis=(0, 1))}
        back = p @ self.weights["o"].T
        for way, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            u = self.weights["u" + way]
            gx, gu = np.zeros_like(self.weights["x" + way]), np.zeros_like(u)
            dh = np.zeros((len(data), n), np.float32)
            for t, h, update, reset, candidate, r in reversed(kept[way]):
                dh = dh + part[t]
                dc = dh * update * (1 - candidate**2)
                dz = dh * (candidate - h) * update * (1 - update)
                dr = dc * r * reset * (1 - reset)
                inner = np.concatenate([dz, dr, dc * reset], axis=1)
                gu += h.T @ inner
                np.add.at(gx, data[:, t], np.concatenate([dz, dr, dc], axis=1))
                dh = dh * (1 - update) + inner @ u.T
            grads["x" + way], grads["u" + way] = gx, gu
        return grads, loss


def train(pieces: list[tuple[bytes, str]], hidden: int = HIDDEN, windows: int = WINDOWS, passes: int = PASSES, seed: int = 7) -> tuple[list[str], Network]:
    """(bytes of letters, language) pairs to the languages in order and the network. Languages weigh alike."""
    languages = sorted({lang for _, lang in pieces})
    rng, found = np.random.default_rng(seed), {lang: [] for lang in languages}
    for piece, lang in pieces:
        if piece:
            found[lang].append(piece)
    network, batch, data, label = Network(len(languages), hidden, seed), 128, [], []
    for k, lang in enumerate(languages):
        if found[lang]:
            pick = rng.permutation(len(found[lang]))
            pick = np.resize(pick, max(1, windows // len(languages))) if len(pick) < windows // len(languages) else pick[: windows // len(languages)]
            data += [found[lang][i] for i in pick]
            label += [k] * len(pick)
    label = np.array(label, np.int64)
    first = {k: np.zeros_like(w) for k, w in network.weights.items()}
    second = {k: np.zeros_like(w) for k, w in network.weights.items()}
    step = 0
    for turn in range(passes if data else 0):
        batches = []
        for same in _by_length(data):
            same = rng.permutation(same)
            batches += [same[i : i + batch] for i in range(0, len(same), batch)]
        for b in rng.permutation(len(batches)):
            grads, _ = network.gradients(_matrix([data[i] for i in batches[b]]), label[batches[b]])
            step += 1
            rate = 0.01 / (1 + turn) * min(1.0, len(batches[b]) / batch + 0.1)
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                network.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return languages, network


def _by_length(pieces: list[bytes]) -> Iterable[np.ndarray]:
    """Positions in `pieces` of those of each length."""
    lengths = np.array([len(r) for r in pieces])
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _matrix(pieces: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)


class Reader:
    """Pools the probabilities of texts."""

    def __init__(self, languages: list[str], network: Network, sequence: int = SEQUENCE, margin: int = MARGIN):
        self._languages, self._network, self._sequence, self._margin = languages, network, sequence, margin

    def _sums(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): sums over all positions."""
        size, margin = self._sequence, self._margin
        blank = b" " * margin
        joined = b"".join(x for t in texts for x in (blank, t, blank)) + b" " * size
        lengths = np.array([len(t) for t in texts], np.int64)
        number = -(-lengths // size)
        who = np.repeat(np.arange(len(texts)), number)
        nth = np.arange(len(who)) - np.repeat(np.cumsum(number) - number, number)
        own = np.minimum(size, lengths[who] - nth * size)
        at = (np.cumsum(lengths + 2 * margin) - lengths - 2 * margin)[who] + nth * size
        order = np.argsort(-own, kind="stable")
        sums = np.zeros((len(texts), len(self._languages)))
        data = np.frombuffer(joined, np.uint8)
        for i in range(0, len(order), 2048):
            part = order[i : i + 2048]
            wide = int(own[part[0]]) + 2 * margin
            rows = np.lib.stride_tricks.sliding_window_view(data, wide)[at[part]]
            np.add.at(sums, who[part], self._network.pooled(rows.T.astype(np.intp), own[part], margin))
        return sums / np.maximum(lengths, 1)[:, None]

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        read = [letters(x) if _lettered(x) else b"" for x in texts]
        out, i = [(UNKNOWN, 0.0)] * len(read), 0
        while i < len(read) and self._languages:
            few, size = [], 0
            while i < len(read) and (not few or size < BLOCK):
                if read[i]:
                    few.append(i)
                    size += len(read[i])
                i += 1
            if few:
                with np.errstate(over="ignore"):
                    sums = self._sums([read[j] for j in few])
                for j, p in zip(few, sums):
                    best = int(p.argmax())
                    out[j] = self._languages[best], min(1.0, float(p[best]))
        return out


def sampled(docs: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> list[tuple[bytes, str]]:
    """Windows of about `sample` labelled documents of each language, chosen by the hash of doc_id among those not held out,
    at most four times as many; `pieces` windows of each at most, evenly spaced over its whole text."""
    known = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").count().orderBy("lang").collect()  # a row a language
    if not counts:
        return []
    grains = 1 << 24
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(grains, grains * sample // r["count"] + 1))]), F.col("lang"))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(grains)) < share).limit(4 * sample * len(counts))

    def windows(batches):
        for batch in batches:
            out = []
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                data = b" " * MARGIN + letters(text.as_py()) + b" " * MARGIN
                n = min(pieces, -(-len(data) // WINDOW))
                out += [(data[at : at + WINDOW], lang) for at in (i * max(0, len(data) - WINDOW) // max(1, n - 1) for i in range(n))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.string()))], ["data", "lang"])

    return sorted((bytes(r["data"]), r["lang"]) for r in few.select("text", "lang").mapInArrow(windows, "data binary, lang string").collect())


def predicted(docs: DataFrame, sample: int = SAMPLE, hidden: int = HIDDEN) -> DataFrame:
    """`docs` (doc_id, text, lang) to (doc_id, held_out, lang_pred, score), one row each.

    Trained on documents with a language whose crc32(doc_id as text) mod 3 is not 1; those with remainder 1 are held
    out, a null doc_id is neither. lang_pred is a trained language, or `und` with score 0 for texts that are
    null or have no letter, or if there is nothing to train on. score is the mean probability of lang_pred over all
    positions of the text. Repeated rows come back as often; other columns, of any name, are ignored; an empty table gives no
    rows. A very long text is read in as many sequences as it needs, in one task.
    """
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text"))
    return _labelled(rows, docs, sample, hidden, "lang_pred", "score")


def _labelled(rows: DataFrame, docs: DataFrame, sample: int, hidden: int, lang: str, score: str) -> DataFrame:
    """`rows` with columns `lang` and `score` in the place of their last column, a text."""
    model = docs.sparkSession.sparkContext.broadcast(train(sampled(docs, sample), hidden))
    names = rows.columns[:-1]

    def each(batches):
        alone()
        read = Reader(*model.value)
        for batch in batches:
            out, texts = [], batch.column(len(names))
            for k in range(0, batch.num_rows, 512):
                out += read(texts.slice(k, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], [*names, lang, score])

    return rows.mapInArrow(each, rows.select(*map(quoted, names)).schema.add(lang, "string").add(score, "double"))


def identified(docs: DataFrame, sample: int = SAMPLE, hidden: int = HIDDEN, sure: float = SURE) -> DataFrame:
    """`docs` without those of no language: texts that are null or have no letter, and those whose likeliest language has a mean
    probability under `sure`. All columns are kept, of any name; a null `lang` becomes the language found. Without a
    language to train on, texts with a letter stay. Repeated rows are judged alike; an empty table stays empty; a text of any length is read
    whole, in as many sequences as it needs."""
    text, lang, score = (unused(docs, x) for x in ("_text", "_lang", "_score"))
    found = _labelled(docs.select("*", F.col("text").cast("string").alias(text)), docs, sample, hidden, lang, score)
    if docs.where("lang is not null and text is not null").isEmpty():
        return found.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))).drop(lang, score)
    kept = found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= sure))
    return kept.withColumn("lang", F.coalesce(F.col("lang"), F.col(lang).cast(docs.schema["lang"].dataType))).drop(lang, score)
