"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words. The examples are a bounded sample of the labelled rows of each class; all their terms are indexed, and document
frequencies come from all documents. A term's weight is its TF-IDF times its relevance, chi2 / (chi2 + 20) of the classes in the
sample: no term goes, but words that both classes use alike count little. A text's score is the vote of its nearest examples,
weighted by distance and by the sampling rate of their class, then calibrated on the examples themselves, each held out of its
own vote.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.shared import drop_written, release, table, written

#: At most so many examples of each class. Chi-square (1 degree of freedom) at which a term's relevance is a half.
EXAMPLES, HALF_CHI2 = 2500, 20.0
NEIGHBOURS, BLOCK, FREQUENT, FAR, PRIOR_WEIGHT = 15, 64, 16, 0.05, 0.2
#: Bytes of words that a task remembers; scores that it remembers (of fixed size).
WORD_BYTES, SCORES = 24 << 20, 50_000
SEED = "examples"
WORD = re.compile(r"[^\W\d_]+")


@B.returning
def _terms(batches):
    """(term): the distinct terms of a task's texts."""
    found: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found.update(WORD.findall((text or "").lower()))
    terms = sorted(found)
    for i in range(0, len(terms), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 20_000], pa.string())], names=["term"])


class Reader:
    """The terms of white-space words, over a vocabulary; words are remembered up to WORD_BYTES."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.seen, self.several, self.held = vocabulary, {}, [], 0

    def _code(self, word: bytes) -> int:
        """The term of a word, -1 for none, -2 - the place in self.several for several."""
        own = [self.vocabulary[x] for x in WORD.findall(word.decode("utf-8").lower()) if x in self.vocabulary]
        if len(own) > 1:
            self.several.append(own)
        self.held += len(word) + 100 + 60 * len(own)
        return -1 if not own else own[0] if len(own) == 1 else -1 - len(self.several)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count), by text and term."""
        if self.held > WORD_BYTES:
            self.seen, self.several, self.held = {}, [], 0
        seen, sizes, codes = self.seen, [], []
        for text in texts:
            own = text.split()
            found = list(map(seen.get, own))
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        found[i] = seen.get(own[i])
                        if found[i] is None:
                            found[i] = seen[own[i]] = self._code(own[i])
            sizes.append(len(found))
            codes.append(np.array(found, np.int64))
        code, text = np.concatenate([np.zeros(0, np.int64), *codes]), np.repeat(np.arange(len(texts)), sizes)
        many = np.flatnonzero(code < -1)
        lists = [self.several[i] for i in (-2 - code[many]).tolist()]
        code = np.concatenate((code, np.array([t for x in lists for t in x], np.int64)))
        text = np.concatenate((text, np.repeat(text[many], [len(x) for x in lists])))
        n = max(1, len(self.vocabulary))
        both, count = np.unique((text * n + code)[code >= 0], return_counts=True)
        return both // n, both % n, count


def _vectors(vocabulary: pa.Array):
    """(doc_id, terms, counts) of each text, over the vocabulary. Tasks make a dict of it, so that the driver needs none."""

    def run(batches):
        reader = Reader({t: i for i, t in enumerate(vocabulary.to_pylist())})
        for batch in B.groups(batches):
            raw, at = B.buffers(batch.column("text"))
            text, term, count = reader.read(list(B.texts(raw, at)))
            offsets = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *lists], names=["doc_id", "terms", "counts"])

    return B.returning(run)


def _held(n_terms: int):
    """(term, n): the documents of a task that have each term."""

    def run(batches):
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["term", "n"])

    return B.returning(run)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, values) of a column of lists of ints without nulls."""
    size = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.offsets.to_numpy()) for x in column.chunks)]).astype(np.int64)
    return np.cumsum(size) - size, size, np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in column.chunks)])


class BlockMaxIndex:
    """Posting lists of vectors in blocks of examples, with the largest weight of each frequent term in each block.

    The lists of terms that over a FREQUENT-th of the examples have are laid out in full, a weight for each place of a block."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, at: np.ndarray, n_terms: int, block: int = BLOCK):
        """The vector of example i is terms and weights [at[i] : at[i + 1]]; weights are 0 or more."""
        n = len(at) - 1
        strongest = np.array([terms[a + weights[a:b].argmax()] if b > a else n_terms for a, b in zip(at, at[1:], strict=False)], np.int64)
        self.order, self.n_blocks = np.lexsort((np.arange(n), strongest)), -(-n // block)  # like with like, for tight bounds
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.size, places = self.n_blocks * block, np.repeat(self.place.astype(np.int32), np.diff(at))
        held = np.bincount(terms, minlength=n_terms)
        frequent = np.flatnonzero(held * FREQUENT > n)
        self.row = np.full(n_terms, -1)
        self.row[frequent] = np.arange(len(frequent))
        full = self.row[terms] >= 0
        self.full = np.zeros((len(frequent), self.n_blocks, block))
        self.full.reshape(len(frequent), self.size)[self.row[terms[full]], places[full]] = weights[full]
        self.most = self.full.max(axis=2, initial=0)
        by = np.flatnonzero(~full)
        by = by[np.lexsort((places[by], terms[by]))]
        self.places, self.weights = places[by], weights[by]
        self.first = np.concatenate(([0], np.cumsum(np.where(self.row < 0, held, 0))))  # posting of each term

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest inner product over 0 (exact; equal ones by number), and the products.

        Rare terms are added up over their lists. What the frequent ones can add is bounded by block: only blocks that may reach
        the k-th sum so far are added up in full."""
        size = self.first[terms + 1] - self.first[terms]
        at = B.ranges(self.first[terms], size)
        sums = np.bincount(self.places[at], np.repeat(weights, size) * self.weights[at], minlength=self.size).astype(float)
        if without >= 0:
            sums[self.place[without]] = 0
        frequent = self.row[terms] >= 0
        if frequent.any():
            rows, own = self.row[terms[frequent]], weights[frequent]
            least = np.partition(sums, -k)[-k] if len(sums) > k else 0.0
            by_block = sums.reshape(self.n_blocks, -1)
            may = np.flatnonzero(by_block.max(axis=1) + own @ self.most[rows] >= least - 1e-8)
            some = slice(None) if 4 * len(may) > self.n_blocks else may
            for row, w in zip(rows.tolist(), own.tolist(), strict=True):
                by_block[some] += w * self.full[row, some]
            if without >= 0:
                sums[self.place[without]] = 0
        least = np.partition(sums, -k)[-k] if len(sums) > k else 0.0
        near = np.flatnonzero((sums >= least - 1e-8) & (sums > 1e-9))
        found, ids = np.round(sums[near], 9), self.order[near]
        top = np.lexsort((ids, -found))[:k]
        return ids[top], found[top]


class Model:
    def __init__(self, terms: np.ndarray, counts: np.ndarray, at: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rates: tuple[float, float], k: int = NEIGHBOURS):
        """Example i has terms and counts [at[i] : at[i + 1]]. weight: of each term; rates: learning rows for each example of class 0, 1."""
        self.weight, self.k, self.toxic = weight, k, toxic.astype(float)
        self.share = np.where(toxic == 1, rates[1], rates[0])
        self.prior = float((self.toxic * self.share).sum() / self.share.sum()) if len(toxic) else 0.0
        vectors = np.zeros(len(terms))
        for a, b in zip(at, at[1:], strict=False):
            vectors[a:b] = self.vector(terms[a:b], counts[a:b])
        self.index = BlockMaxIndex(terms, vectors, at, len(weight))
        self.slope, self.shift = 1.0, 0.0
        if 0 < self.prior < 1:
            votes = np.array([self.vote(terms[a:b], vectors[a:b], without=i)[0] for i, (a, b) in enumerate(zip(at, at[1:], strict=False))])
            self.slope, self.shift = calibration(votes, self.toxic, self.share)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        length = np.sqrt((w * w).sum())
        return w / length if length else w

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, list[tuple[int, float]]]:
        ids, cosine = self.index.nearest(terms, weights, self.k, without) if len(terms) else (np.zeros(0, np.int64), np.zeros(0))
        w = self.share[ids] / self.share.mean() / (FAR + 1 - np.minimum(cosine, 1)) * cosine
        raw = ((w * self.toxic[ids]).sum() + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT)
        return float(raw), list(zip(ids.tolist(), cosine.tolist(), strict=True))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        if not 0 < self.prior < 1:
            return self.prior, []
        raw, near = self.vote(terms, self.vector(terms, counts))
        return float(1 / (1 + np.exp(-(self.slope * _logit(raw) + self.shift)))), near


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def calibration(votes: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (over 0) and shift of the logistic curve over the votes' log odds, with a small ridge, by Newton's method."""
    x, w = _logit(votes), share / share.sum() * len(y)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.1 * b])
        v = w * p * (1 - p)
        hess = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
    return max(a, 0.05), b


def _scores(model: Model, ids: list[int]):
    def run(batches):
        near_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", near_type)])
        seen: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            scores, evidence = [], []
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                terms, counts = terms.values.to_numpy(), counts.values.to_numpy()
                key = hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest()
                if key not in seen:
                    if len(seen) >= SCORES:
                        seen.clear()
                    score, near = model.score(terms.astype(np.int64), counts)
                    seen[key] = score, [{"doc_id": ids[i], "toxic": int(model.toxic[i]), "similarity": s} for i, s in near[:3]]
                score, near = seen[key]
                scores.append(score)
                evidence.append(near)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, near_type)], schema=schema)

    return B.returning(run)


def relevance(terms: np.ndarray, at: np.ndarray, toxic: np.ndarray, n_terms: int, half: float = HALF_CHI2) -> np.ndarray:
    """chi2 / (chi2 + half) of each term, over the examples that have it; 1 for all with half = 0, which leaves plain TF-IDF."""
    if half == 0:
        return np.ones(n_terms)
    n = [max(1, int((toxic == c).sum())) for c in (0, 1)]
    clean, bad = (np.bincount(terms[np.repeat(toxic == c, np.diff(at))], minlength=n_terms) for c in (0, 1))
    held, odd = np.maximum(clean + bad, 1), bad / n[1] - clean / n[0]
    chi2 = odd * odd * n[0] * n[1] / held * sum(n) / (sum(n) + 1 - held)
    return chi2 / (chi2 + half)


def fitted(own: pa.Table, held: np.ndarray, n: int, sizes: dict[int, int], half_chi2: float = HALF_CHI2, k: int = NEIGHBOURS) -> tuple[Model, list[int]]:
    """The model of the examples own (doc_id, terms, counts, toxic), and their doc_ids. held: of n documents those that have each term; sizes: learning rows by class.

    What is made of all entries of the vectors has 4 bytes for each, but for their weights, and goes as soon as it is used: all this is the driver's memory."""
    own = own.combine_chunks()
    ids, toxic = own.column("doc_id").to_pylist(), own.column("toxic").to_numpy().astype(np.int64)
    (start, size, terms), counts = _lists(own.column("terms")), _lists(own.column("counts"))[2]
    del own
    order = sorted(range(len(ids)), key=lambda i: (ids[i], terms[start[i] : start[i] + size[i]].tobytes(), counts[start[i] : start[i] + size[i]].tobytes()))
    own_ranges = [slice(start[i], start[i] + size[i]) for i in order]
    terms, counts = (np.concatenate([np.zeros(0, np.int32), *(x[r] for r in own_ranges)]) for x in (terms, counts))
    at, ids, toxic = np.concatenate(([0], np.cumsum(size[order]))), [ids[i] for i in order], toxic[order]
    weight = (np.log((1 + n) / (1 + held)) + 1) * relevance(terms, at, toxic, len(held), half_chi2)
    return Model(terms, counts, at, toxic, weight, tuple(sizes.get(c, 0) / max(1, int((toxic == c).sum())) for c in (0, 1)), k), ids


def score_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, half_chi2: float = HALF_CHI2, k: int = NEIGHBOURS) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, score, predicted, evidence, a row for each row of docs.

    All rows of labels are learned from: leave out what must not be. The examples are, of each class, the `examples` rows with the
    least hash of doc_id that have a document. half_chi2: the chi-square at which a term counts half; 0: plain TF-IDF. evidence: the
    three nearest examples with their labels and cosines; of equally near ones the smaller doc_id.

    Null and empty texts have no terms; they and texts without a known term get the calibrated score of no neighbours. Terms that no
    example has weigh nothing, as they tell nothing of the classes. Null doc_ids in labels and labels other than 0 and 1 are not
    learned from; a doc_id labelled both 0 and 1 counts as 1. Without labels of both classes every score is the share of toxic
    ones (0 without any). Repeated rows and null doc_ids of docs get a row each. An empty table gives an empty table. Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = written(labels, "labels")
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.lit(SEED), "doc_id"), F.col("doc_id")]
    sample = written(labels.filter("toxic = 0").orderBy(*order).limit(examples).union(labels.filter("toxic = 1").orderBy(*order).limit(examples)), "examples")
    # what goes to the driver is bounded by the sample: its terms, how many documents have each, its vectors
    found = docs.join(F.broadcast(sample.select("doc_id")), "doc_id").select("text").mapInArrow(_terms, "term string").distinct().toArrow()
    vocabulary = found.column("term").combine_chunks()
    vocabulary = vocabulary.take(pc.sort_indices(vocabulary))
    vectors = written(docs.mapInArrow(_vectors(vocabulary), "doc_id long, terms array<int>, counts array<int>"), "vectors")
    n, df = vectors.count(), np.zeros(len(vocabulary))
    held = vectors.select("terms").mapInArrow(_held(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[held.column("term").to_numpy()] = held.column("n").to_numpy()
    del found, vocabulary, held
    release(docs.sparkSession)  # the driver's JVM gives way to what follows
    model, ids = fitted(vectors.join(F.broadcast(sample), "doc_id").distinct().toArrow(), df, n, sizes, half_chi2, k)
    B.give_back()
    out = vectors.mapInArrow(_scores(model, ids), "doc_id long, score double, evidence array<struct<doc_id: long, toxic: int, similarity: double>>")
    del model, ids
    B.give_back()
    for x in (labels, sample):
        drop_written(x)
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").filter(fold != 0)
    out = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


SQL: dict[str, str] = {}
QUERIES = {"op2_toxicity": op2_toxicity}
