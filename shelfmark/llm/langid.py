"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads the bytes of a word between two edge marks, forwards and backwards, and labels every position, the edges too; bytes
that are no letters are edges. A document's probabilities are the means over all positions of all its words. Words are read on their own, so that
equal words are read once for a task; a long word is read piece by piece, each piece taking over the state that the one before left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.shared import table

#: The training sample: at most so many documents of each language, read whole.
SAMPLE_DOCS = 150
#: Backpropagation goes through so many bytes: longer words are trained on in consecutive pieces.
THROUGH = 24
HIDDEN, EMBED, STEPS, BATCH, RATE, SEED = 16, 8, 700, 256, 0.02, 7
EDGE = 256  # the mark before and after a word
#: Bytes of a piece of a long word; shorter words that a task remembers.
PIECE, CACHE = 64, 400_000


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Gru:
    """One direction: z and r gates and a candidate state, over a batch of byte sequences in columns of time."""

    def __init__(self, rng, inputs: int, hidden: int):
        scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": scale(inputs, 3 * hidden), "U": scale(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32)}
        self.h = hidden

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False, state: np.ndarray | None = None):
        """x (time, batch, inputs), mask (time, batch, 1): a state stands still where the mask is 0. state: to begin with, else 0."""
        h, n, out, tape = self.h, x.shape[1], [], []
        state = np.zeros((n, h), np.float32) if state is None else state
        U, fed = self.p["U"], x @ self.p["W"] + self.p["b"]
        for t in range(len(x)):
            gates = _sigmoid(fed[t, :, : 2 * h] + state @ U[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(fed[t, :, 2 * h :] + (r * state) @ U[:, 2 * h :])
            after = state + mask[t] * (1 - z) * (c - state)
            if keep:
                tape.append((state, z, r, c))
            out.append(after)
            state = after
        return np.stack(out), tape

    def backward(self, x, mask, tape, grads):
        """Gradients of the parameters and of x from those of the states, back through time."""
        h, U, W = self.h, self.p["U"], self.p["W"]
        dW, dU, db, dx = np.zeros_like(W), np.zeros_like(U), np.zeros_like(self.p["b"]), np.zeros_like(x)
        carry = np.zeros_like(grads[0])
        for t in range(len(x) - 1, -1, -1):
            state, z, r, c = tape[t]
            d = grads[t] + carry
            m = mask[t]
            dc = d * m * (1 - z) * (1 - c * c)
            dz = d * m * (state - c) * z * (1 - z)
            drs = dc @ U[:, 2 * h :].T
            dr = drs * state * r * (1 - r)
            g = np.concatenate((dz, dr, dc), axis=1)
            dW += x[t].T @ g
            db += g.sum(0)
            dU[:, : 2 * h] += state.T @ g[:, : 2 * h]
            dU[:, 2 * h :] += (r * state).T @ dc
            dx[t] = g @ W.T
            carry = d * (1 - m * (1 - z)) + drs * r + g[:, : 2 * h] @ U[:, : 2 * h].T
        return {"W": dW, "U": dU, "b": db}, dx


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, embed: int = EMBED, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.emb = (rng.standard_normal((257, embed)) * 0.5).astype(np.float32)
        self.ahead, self.back = Gru(rng, embed, hidden), Gru(rng, embed, hidden)
        self.out = (rng.standard_normal((2 * hidden, len(labels))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    @staticmethod
    def laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) with time first: edge, bytes, edge; words longer than the rest are not cut, the batch is as long as its longest."""
        size = max(map(len, words)) + 2
        ids, mask = np.full((size, len(words)), EDGE), np.zeros((size, len(words), 1), np.float32)
        for i, w in enumerate(words):
            ids[1 : len(w) + 1, i] = np.frombuffer(w, np.uint8)
            mask[: len(w) + 2, i] = 1
        return ids, mask

    def states(self, ids, mask, keep: bool = False):
        x = self.emb[ids]
        a, ta = self.ahead.forward(x, mask, keep)
        b, tb = self.back.forward(x[::-1], mask[::-1], keep)
        return x, np.concatenate((a, b[::-1]), axis=2), ta, tb

    def log_probs(self, states):
        s = states @ self.out + self.bias
        s = s - s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """For each word the probabilities of the labels, summed over its positions."""
        ids, mask = self.laid_out(words)
        return (np.exp(self.log_probs(self.states(ids, mask)[1])) * mask).sum(axis=0)

    def long_score(self, word: bytes, piece: int = PIECE) -> np.ndarray:
        """As word_scores for one word of any length, in memory for a piece: forwards for the states between pieces, then backwards."""
        ids = np.concatenate(([EDGE], np.frombuffer(word, np.uint8), [EDGE]))
        xs = [self.emb[ids[i : i + piece]][:, None] for i in range(0, len(ids), piece)]
        ones, ahead, back, total = np.ones((piece, 1, 1), np.float32), [None], None, 0.0
        for x in xs:
            ahead.append(self.ahead.forward(x, ones, state=ahead[-1])[0][-1])
        for x, state in zip(reversed(xs), ahead[-2::-1], strict=True):
            forwards, backwards = self.ahead.forward(x, ones, state=state)[0], self.back.forward(x[::-1], ones, state=back)[0]
            back = backwards[-1]
            total = total + np.exp(self.log_probs(np.concatenate((forwards, backwards[::-1]), axis=2))).sum(axis=(0, 1))
        return total

    def parameters(self):
        return [self.emb, *(g.p[k] for g in (self.ahead, self.back) for k in "WUb"), self.out, self.bias]

    def gradients(self, words: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions, and its gradient by backpropagation through time."""
        ids, mask = self.laid_out(words)
        x, states, ta, tb = self.states(ids, mask, keep=True)
        logp = self.log_probs(states)
        goal = np.eye(len(self.labels), dtype=np.float32)[y][None]
        total = mask.sum()
        d = (np.exp(logp) - goal) * mask / total
        d_out, d_bias = np.tensordot(states, d, ((0, 1), (0, 1))), d.sum((0, 1))
        ds = d @ self.out.T
        h = self.ahead.h
        ga, xa = self.ahead.backward(x, mask, ta, ds[:, :, :h])
        gb, xb = self.back.backward(x[::-1], mask[::-1], tb, ds[::-1, :, h:])
        d_emb = np.zeros_like(self.emb)
        np.add.at(d_emb, ids.ravel(), ((xa + xb[::-1]) * mask).reshape(-1, self.emb.shape[1]))
        return float(-(logp * goal * mask).sum() / total), [d_emb, *(g[k] for g in (ga, gb) for k in "WUb"), d_out, d_bias]

    def train(self, words: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> None:
        """Adam, each language as often as any other."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        params = self.parameters()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(i, batch // len(by) + 1) for i in by])
            _, grads = self.gradients([words[i] for i in pick], y[pick])
            now = rate * min(1, 3 * (1 - t / (steps + 1)))
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                g = np.clip(g, -1, 1)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Fit on docs (doc_id, text, lang): on all distinct words of the sample_docs documents of each language with the least hash of
    doc_id and length of text. None if no row has text and lang."""
    docs = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", F.xxhash64(F.col("doc_id").cast("string"), F.length("text")).alias("h"), "text")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return None
    # a bound on the hash that leaves about twice the sample of each language, then the exact cut
    share = F.element_at(F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, (2 * sample_docs + 50) / sizes[k]))]), F.col("lang"))
    near = docs.filter((F.col("h") / float(1 << 64) + 0.5) <= share)
    words = F.array_sort(F.array_distinct(F.split("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))
    chosen = near.select("lang", "h", words.alias("words")).withColumn("rank", rank).filter(F.col("rank") <= sample_docs)
    rows = chosen.select("lang", F.explode("words").alias("word")).filter("word <> ''").distinct().collect()
    held = ((r.lang, r.word.encode().lower()) for r in rows)
    pairs = sorted({(lang, w[i : i + THROUGH]) for lang, w in held for i in range(0, len(w), THROUGH)})
    if not pairs:
        return None
    net = Network(labels)
    net.train([w for _, w in pairs], np.array([labels.index(k) for k, _ in pairs]))
    return net


LETTER = B.SPACE.copy()
LETTER[:] = False
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _predict(net: Network | None):
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        seen: dict[bytes, int] = {}
        scores_of = np.zeros((1024, len(net.labels) if net else 0))
        for batch in B.groups(batches):
            raw, at = B.buffers(batch.column("text"))
            # bytes of letters only; the rest parts words as white space does
            counted = [text.lower().translate(PARTS).split() for text in B.texts(raw, at)]
            if net is not None:
                if len(seen) > CACHE:
                    seen.clear()
                fresh = sorted({w for own in counted for w in own if len(w) <= PIECE}.difference(seen), key=len)
                if len(scores_of) < len(seen) + len(fresh):
                    scores_of = np.concatenate((scores_of, np.zeros((len(seen) + len(fresh), len(net.labels)))))
                i = 0
                while i < len(fresh):
                    j = min(len(fresh), i + max(1, min(4096, 65536 // (len(fresh[i]) + 2))))
                    while j > i + 1 and len(fresh[j - 1]) > 2 * len(fresh[i]) + 8:
                        j = i + (j - i + 1) // 2
                    scores_of[len(seen) : len(seen) + j - i] = net.word_scores(fresh[i:j])
                    seen.update(zip(fresh[i:j], range(len(seen), len(seen) + j - i), strict=True))
                    i = j
            langs, scores = [], []
            for own, text in zip(counted, batch.column("text"), strict=True):
                if net is None or not own or not any(map(str.isalpha, text.as_py())):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                known = [k for w in own if (k := seen.get(w)) is not None]
                total = scores_of[known].sum(axis=0)
                for w in own if len(known) < len(own) else ():
                    if len(w) > PIECE:
                        total = total + net.long_score(w)
                p = total / (sum(map(len, own)) + 2 * len(own))
                k = int(p.argmax())
                langs.append(net.labels[k])
                scores.append(float(min(1.0, p[k])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return run


PARTS = bytes(c if LETTER[c] else 32 for c in range(256))


def identify(docs: DataFrame, learn_from: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, lang_pred, score: the language with the largest pooled probability, and that probability.

    A document's probabilities are the means over all positions of all its words. The network is fitted on at most SAMPLE_DOCS
    documents of each language. lang_pred is `und`, score 0, for a null text, one
    without a letter, and all texts if learn_from (doc_id, text, lang) has no row with both text and lang. Repeated rows and
    null doc_ids get a row each. An empty table gives an empty table. Other columns are ignored.
    """
    net = learn(learn_from)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    out = identify(docs, docs.filter(fold != 2).select("doc_id", "text", "lang"))
    return out.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op10_language": op10_language}
