"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

Each text segment (blanks and the word after them) is merged on its own, as the model's merges never cross from a word into the
blanks after it. An agenda holds the candidate merges, best score first, leftmost of equals; the one that is taken from it is
skipped if a hash of the seed, the document, the epoch, the segment's place in the text, the merge's place and its pair falls under the
dropout rate, so that every place in every repeat has draws of its own. All segmentations decode to the same text. Rate 0
gives the model's own segmentation.

What the agenda offers next depends only on the segment and on what was skipped before. So each distinct short segment has a tree of
decisions, grown as occurrences need it: an occurrence draws its way from node to node, and nothing is merged twice. Long
segments have an agenda of their own each time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import bytesops as B
from shelfmark.llm.session import free
from shelfmark.shared import table

RATE, SEED = 0.1, 1
BLANK, NONE = "▁", 1 << 30
#: Stands for a character of the text that looks like the model's blank. No UTF-8 text holds it.
LOOKALIKE = "\udfff"
#: Longer segments have no tree. An encoder forgets its trees beyond so many segments or nodes, which are of fixed size then.
SHORT, SEGMENTS, NODES = 32, 400_000, 4_000_000
#: Segments that are walked at a time.
SLICE = 200_000
#: (segments, nodes, segments at a time, bytes of texts at a time) where other work has left an executor little memory: about a third of it, for more merging of what was forgotten.
NARROW = (100_000, 700_000, 100_000, 1 << 19)
SEGMENT = re.compile(" *[^ ]+| +")
_codecs: dict[str, Codec] = {}
_encoders: dict[tuple, Encoder] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def drawn(start, end, key):
    """The part of a draw that is the merge's own: its place in the segment and its pair."""
    with np.errstate(over="ignore"):
        return B.mix((start.astype(np.uint64) << np.uint64(32) | end.astype(np.uint64)) * B.WORD_P + key.astype(np.uint64))


class Codec:
    """The model's merges, for many short segments at once and for one long segment."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.piece = {self.sp.id_to_piece(i): i for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.piece):
            raise ValueError("the model has pieces with a blank after other characters: segments can't be merged on their own")
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-self.sp.get_score(i), i)))}
        pairs = []
        for text, i in self.piece.items():
            for cut in range(1, len(text)):
                a, b = self.piece.get(text[:cut]), self.piece.get(text[cut:])
                if a is not None and b is not None:
                    pairs.append((a * n + b, rank[i], i))
        table_ = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.n, self.keys, self.ranks, self.merged = n, table_[:, 0], table_[:, 1], table_[:, 2]
        self.byte = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.char = np.full(0x110000, -1, np.int32)
        for text, i in self.piece.items():
            if len(text) == 1:
                self.char[ord(text)] = i

    @functools.cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """(rank, merged id) of each pair, for long segments only: most workers meet none."""
        return {k: (r, i) for k, r, i in zip(self.keys.tolist(), self.ranks.tolist(), self.merged.tolist(), strict=True)}

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair, rank NONE where there is none."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.n + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.merged[at]

    def symbols(self, segments: list[str]) -> np.ndarray:
        """The piece of each character of the segments, -1 where there is none."""
        return self.char[np.frombuffer("".join(segments).replace(BLANK, LOOKALIKE).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _bytes(self, ids: list[int], text: str, starts: list[int]) -> list[int]:
        """ids with characters without a piece as bytes."""
        return [x for v, at in zip(ids, starts, strict=True) for x in ((v,) if v >= 0 else [self.byte[b] for b in text[at].encode("utf-8")])]

    def merge(self, segments: list[str], limit: int, keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The ids of all segments, how many each has, and all that the agendas offered, (segment, draw, skipped), each segment's in turn.

        keyed: a key each. All segments at once, the best candidate of each at a time. Segments of like length together waste least."""
        size = np.array(list(map(len, segments)), np.int32)
        n, width = len(segments), int(size.max()) + 1  # the last column stays empty
        inside = np.arange(width)[None] < size[:, None]
        ids = np.full(n * width, -1, np.int32)
        ids[inside.ravel()] = self.symbols(segments)
        at, stop = np.arange(n * width, dtype=np.int32), (np.arange(n, dtype=np.int32) * width + size)
        after, before = at + 1, at - 1  # the first characters of the next symbol and of the one before, as places in ids
        rank, into = np.full(n * width, NONE, np.int32), np.zeros(n * width, np.int32)
        pair = np.flatnonzero(inside.ravel() & np.append(inside.ravel()[1:], False))
        rank[pair], into[pair] = self._look(ids[pair], ids[pair + 1])
        by_row = rank.reshape(n, width)
        offered, live = [], np.arange(n)
        while len(live):
            c = by_row[live].argmin(axis=1) + live * width  # the leftmost of equals
            ok = rank[c] < NONE
            live, c = live[ok], c[ok]
            d = after[c]
            end = after[d]
            draw = drawn(c - live * width, end - live * width, ids[c].astype(np.int64) * self.n + ids[d])
            skip = B.mix(keyed[live] ^ draw) < np.uint64(limit) if limit else np.zeros(len(live), bool)
            offered.append((live, draw, skip))
            rank[c] = NONE
            goes = ~skip
            c, d, end, last = c[goes], d[goes], end[goes], stop[live[goes]]
            ids[c], after[c], ids[d], rank[d] = into[c], end, -2, NONE  # -2: gone
            inner = end < last
            more, end = c[inner], end[inner]
            before[end] = more
            left = before[c]
            c = c[(has := left >= last - size[live[goes]])]
            left = left[has]
            both = np.concatenate((more, left))
            rank[both], into[both] = self._look(ids[both], np.concatenate((ids[end], ids[c])))
        held = inside.ravel() & (ids != -2)
        flat, count = ids[held].astype(np.int64), held.reshape(n, width).sum(axis=1)
        bad = np.zeros(n, bool)
        bad[np.repeat(np.arange(n), count)[flat < 0]] = True
        if bad.any():
            starts, kept = np.cumsum(count) - count, flat[~np.repeat(bad, count)]
            mended = [self._bytes(flat[starts[i] : starts[i] + count[i]].tolist(), segments[i], np.flatnonzero(held.reshape(n, width)[i]).tolist()) for i in np.flatnonzero(bad).tolist()]
            count[bad] = list(map(len, mended))
            flat, of_bad = np.empty(count.sum(), np.int64), np.repeat(bad, count)
            flat[~of_bad], flat[of_bad] = kept, list(itertools.chain.from_iterable(mended))
        row, draw, skip = (np.concatenate(x) for x in zip(*offered, strict=True)) if offered else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
        order = np.argsort(row, kind="stable")
        return flat, count, (row[order], draw[order], skip[order])

    def merge_long(self, segment: str, limit: int, keyed: int) -> np.ndarray:
        """The ids of a segment of any length, by an agenda in a heap."""
        size, n = len(segment), self.n
        first = self.symbols([segment]).astype(np.int64)
        rank, _ = self._look(first[:-1], first[1:])
        ids, after, before = first.tolist(), list(range(1, size + 1)), list(range(-1, size - 1))
        at = np.flatnonzero(rank < NONE)
        agenda = list(zip(rank[at].tolist(), at.tolist(), (at + 2).tolist(), (first[at] * n + first[at + 1]).tolist(), strict=True))
        heapq.heapify(agenda)
        own, pairs = np.uint64(keyed), self.pairs
        while agenda:
            _, c, end, key = heapq.heappop(agenda)
            d = after[c]
            if ids[c] < 0 or d >= size or after[d] != end or ids[c] * n + ids[d] != key:
                continue  # one of the two has been merged
            if limit and int(B.mix(own ^ drawn(np.array([c]), np.array([end]), np.array([key])))[0]) < limit:
                continue
            ids[c], after[c], ids[d] = pairs[key][1], end, -2
            if end < size:
                before[end] = c
                if ids[end] >= 0 and (found := pairs.get(key := ids[c] * n + ids[end])):
                    heapq.heappush(agenda, (found[0], c, after[end], key))
            if (left := before[c]) >= 0 and ids[left] >= 0 and (found := pairs.get(key := ids[left] * n + ids[c])):
                heapq.heappush(agenda, (found[0], left, end, key))
        held = [i for i, v in enumerate(ids) if v != -2]
        return np.array(self._bytes([ids[i] for i in held], segment, held))

    @staticmethod
    def segments(text: str) -> list[str]:
        """The text with a blank before it (as the model has it), cut before each run of blanks; none for an empty text."""
        return SEGMENT.findall(" " + text) if text else []

def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


class Trees:
    """A tree of decisions for each segment. An edge is the number of the node where it leads, -1 if nobody went there yet, else -2 - the number of a result."""

    def __init__(self, start: int = 1 << 14):
        self.roots: dict[str, int] = {}
        self.root = np.full(start, -1, np.int32)
        self.draw, self.edge = np.zeros(start, np.uint64), np.full(2 * start, -1, np.int32)  # 2 * node: taken, 2 * node + 1: skipped
        self.at, self.ids = np.zeros(start + 1, np.int64), np.zeros(4 * start, np.uint32)
        self.n_nodes = self.n_results = 0
        self.roots[""], self.root[0] = 0, -2 - self.results(np.zeros(0, np.uint32), np.zeros(1, np.int64))[0]

    @staticmethod
    def _grown(x: np.ndarray, n: int, fill: int = 0) -> np.ndarray:
        return x if len(x) >= n else np.concatenate((x, np.full(max(n, 2 * len(x)) - len(x), fill, x.dtype)))

    def results(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The numbers of new results, count of the ids each."""
        n, m = len(count), self.n_results
        self.at, self.ids = self._grown(self.at, m + n + 1), self._grown(self.ids, self.at[m] + len(ids))
        self.ids[self.at[m] : self.at[m] + len(ids)] = ids
        self.at[m + 1 : m + n + 1] = self.at[m] + np.cumsum(count)
        self.n_results += n
        return np.arange(m, m + n)

    def nodes(self, n: int) -> int:
        """The first of n new nodes."""
        self.n_nodes += n
        self.draw, self.edge = self._grown(self.draw, self.n_nodes), self._grown(self.edge, 2 * self.n_nodes, -1)
        return self.n_nodes - n


class Encoder:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED, short: int = SHORT, segments: int = SEGMENTS, nodes: int = NODES, walked: int | None = None):
        if not 0 <= rate < 1:
            raise ValueError("rate must be at least 0 and less than 1")
        self.codec, self.rate, self.seed, self.short, self.most = codec(path), rate, seed, short, (segments, nodes)
        self.walked = walked
        self.limit, self.trees = int(rate * (1 << 64)), Trees()

    def _walk(self, segments: list[str], keyed: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The result of each segment, by its number in self.trees, and the long segments, which have none."""
        t, long = self.trees, []
        own = list(map(t.roots.get, segments))
        if None in own:
            for i, x in enumerate(own):
                if x is None:
                    if len(segments[i]) > self.short:
                        long.append(i)
                        own[i] = t.roots[""]
                    else:
                        own[i] = t.roots.setdefault(segments[i], len(t.roots))
            t.root = t._grown(t.root, len(t.roots), -1)
        own = np.array(own, np.int64)
        out = np.empty(len(own), np.int64)
        # those under way: who, the edge that each is on (a root's: -1 - its segment), where it leads, decisions so far
        who, edge, to, depth = np.arange(len(own)), -1 - own, t.root[own], np.zeros(len(own), np.int32)
        waiting = []
        while len(who) or waiting:
            ended = to <= -2
            out[who[ended]] = -2 - to[ended]
            if len(stuck := np.flatnonzero(to == -1)):
                waiting.append((who[stuck], edge[stuck], depth[stuck]))
            inner = np.flatnonzero(to >= 0)
            if len(inner):
                who, node, depth = who[inner], to[inner], depth[inner] + 1
                edge = 2 * node.astype(np.int64) + (B.mix(keyed[who] ^ t.draw[node]) < np.uint64(self.limit))
                to = t.edge[edge]
            elif waiting:
                # all that are left are where nobody went yet: one for each edge goes on, the others follow in its steps
                who, edge, depth = (np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting = []
                _, some = np.unique(edge, return_index=True)
                self._grow(segments, keyed, who[some], edge[some], depth[some])
                to = np.where(edge < 0, t.root[np.maximum(-1 - edge, 0)], t.edge[np.maximum(edge, 0)])
            else:
                who = inner
        return out, long

    def _grow(self, segments: list[str], keyed: np.ndarray, who: np.ndarray, edge: np.ndarray, depth: np.ndarray) -> None:
        """Merge the segments of who and add what their agendas offer beyond depth to the trees, after edge."""
        t = self.trees
        size = np.array([len(segments[i]) for i in who])
        order = np.argsort(size, kind="stable")
        size, i = size[order], 0
        while i < len(order):
            j = min(i + 8192, int(np.searchsorted(size, size[i] + 2, side="right")))
            some = order[i:j]
            ids, count, (row, draw, skip) = self.codec.merge([segments[k] for k in who[some]], self.limit, keyed[who[some]])
            offered = np.bincount(row, minlength=len(some))
            step = np.arange(len(row)) - np.repeat(np.cumsum(offered) - offered, offered)
            new = step >= depth[some][row]
            row, draw, skip = row[new], draw[new], skip[new]
            first = t.nodes(len(row))
            number = np.arange(first, first + len(row))
            t.draw[number] = draw
            change = np.flatnonzero(np.diff(row, prepend=-1))
            ends = -2 - t.results(ids, count)
            nexts = number + 1
            nexts[np.append(change[1:], len(row))[: len(change)] - 1] = ends[row[change]]
            t.edge[2 * number + skip] = nexts
            to = ends.copy()
            to[row[change]] = number[change]
            whence = edge[some]
            t.root[-1 - whence[whence < 0]] = to[whence < 0]
            t.edge[whence[whence >= 0]] = to[whence >= 0]
            i = j

    def encode_all(self, texts: list[str], epochs: list[int], names: list[str] | None = None) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of each text. epoch: which of the repeats of the document this is; name: the document."""
        cut = [self.codec.segments(t) for t in texts]
        own = list(itertools.chain.from_iterable(cut))
        bases = [int.from_bytes(hashlib.blake2b(f"{self.seed}:{e}:{d}".encode(), digest_size=8).digest(), "little") for e, d in zip(epochs, names or [""] * len(texts), strict=True)]
        places = np.concatenate([np.zeros(0, np.uint64), *(np.arange(1, len(c) + 1, dtype=np.uint64) for c in cut)])
        keyed = B.mix(np.repeat(np.array(bases, np.uint64), [len(c) for c in cut]) ^ B.mix(places))
        sizes, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        walked = self.walked or SLICE
        for i in range(0, len(own), walked):
            some, key = own[i : i + walked], keyed[i : i + walked]
            if len(self.trees.roots) > self.most[0] or self.trees.n_nodes > self.most[1]:
                self.trees = t = Trees()  # those before go at once
            found, long = self._walk(some, key)
            t = self.trees
            size = t.at[found + 1] - t.at[found]
            ids = t.ids[np.arange(size.sum()) + np.repeat(t.at[found] - np.cumsum(size) + size, size)]
            if long:
                merged = [self.codec.merge_long(some[k], self.limit, int(key[k])) for k in long]
                ids = np.insert(ids, np.repeat((np.cumsum(size) - size)[long], [len(x) for x in merged]), np.concatenate(merged))
                size[long] = [len(x) for x in merged]
            sizes.append(size)
            parts.append(ids)
        ids, ends = np.concatenate(parts).astype("<u4"), np.append(0, np.cumsum(np.concatenate(sizes)))
        bounds = ends[np.cumsum([0, *(len(c) for c in cut)])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str, rate: float, seed: int, narrow: bool = False) -> Encoder:
    """One for each worker, so that later tasks find its trees."""
    if (path, rate, seed, narrow) not in _encoders:
        _encoders.clear()
        _encoders[path, rate, seed, narrow] = Encoder(path, rate, seed, SHORT, *NARROW[:3]) if narrow else Encoder(path, rate, seed)
    return _encoders[path, rate, seed, narrow]


def _encode(path: str, rate: float, seed: int, narrow: bool = False):
    def run(batches):
        own = encoder(path, rate, seed, narrow)
        for batch in B.groups(batches, most=NARROW[3]) if narrow else B.groups(batches):
            names = batch.schema.names  # the last two: epoch and document
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = own.encode_all(texts, batch.columns[-2].fill_null(0).to_pylist(), batch.columns[-1].to_pylist())
            decoded = own.codec.sp.decode([np.frombuffer(x, "<u4").tolist() for x in coded], num_threads=1) if texts else []
            more = [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(decoded, pa.string()), pa.array([a == b for a, b in zip(texts, decoded, strict=True)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *more], names=[*names[:-2], "n_tokens", "ids", "decoded", "lossless"])

    return B.returning(run)


def encode_pieces(docs: DataFrame, model: str, rate: float = RATE, seed: int = SEED, epoch: str | None = None, name: str = "doc_id", narrow: bool = False) -> DataFrame:
    """docs (text, ...) with n_tokens, ids (little-endian unsigned 32-bit), decoded (the text that the ids decode to) and lossless.

    epoch: a column that numbers the repeats of a document; each is cut with other keys. name: the column that names the
    document; without it all rows are one document. narrow: with less memory and more time (see NARROW), the same ids. The same seed, document, epoch and text always give the same ids.

    Null and empty texts have no ids and decode to an empty text, lossless. Rows are independent: repeated rows and null doc_ids get a row each. An
    empty table gives an empty table. Columns of docs stay; those named n_tokens, ids, decoded or lossless are replaced.
    """
    docs = docs.drop("n_tokens", "ids", "decoded", "lossless").withColumn("text", F.col("text").cast("string"))
    more = [("n_tokens", T.LongType()), ("ids", T.BinaryType()), ("decoded", T.StringType()), ("lossless", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(*x) for x in more]])
    more = [free(docs, x) for x in ("epoch", "document")]
    docs = docs.select("*", (F.col(epoch).cast("long") if epoch else F.lit(0).cast("long")).alias(more[0]), (F.col(name).cast("string") if name in docs.columns else F.lit("")).alias(more[1]))
    return docs.mapInArrow(_encode(model, rate, seed, narrow), schema)


def op6_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, model or default_model())
    return out.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")


SQL: dict[str, str] = {}
QUERIES = {"op6_pieces": op6_pieces}
