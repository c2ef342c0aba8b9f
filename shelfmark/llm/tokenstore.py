"""Token ids in a content-addressed store: chunks cut by a rolling hash, document recipes, Merkle roots."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.session import BATCH_BYTES
from shelfmark.shared import drop_written, scratch, shuffles_dropped, table, width, written

END_ID = 1
#: A chunk ends where the hash of WINDOW ids has its low CUT_BITS bits 0, and after LONGEST ids at the latest.
WINDOW, CUT_BITS, LONGEST = 8, 8, 2048
#: Parts of words that an encoder remembers, and the bytes that they and their ids may hold.
PARTS, MOST_BYTES = 1_200_000, 64 << 20

#: Fixed value: what the pre-tokenizer keeps, in the tokenizers whose words are encoded on their own.
PARTED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a byte of a word is: 1 of a letter up to U+00FF, 2 a digit, 3 another printable ASCII character, 0 for the library. The apostrophe may begin a part of
#: letters; 0xC3 begins the letters over U+00BF, and signs with these two bytes; words with the first bytes of other characters are odd by them.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[[0x27, 0x97, 0xB7]] = 0
KIND[0x30:0x3A] = 2
KIND[[*range(0x61, 0x7B), *range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0), 0xC3]] = 1
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of texts by way of their words.

    For tokenizers that drop white space and never look across it (word_bpe_49k.json, by its settings), a text's ids are those of its words in
    turn, and A-Z may be lowered first. A word of letters up to U+00FF, digits and other ASCII characters but the apostrophe falls into
    independent parts for its pattern: runs of letters, digits, runs of others. They are found as arrays of bytes and go to the library's model
    directly, each distinct one about once per worker. Words with anything else are one part, for the whole library call.
    """

    def __init__(self, path: str, parts: int = PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.most = Tokenizer.from_file(path), parts
        self.model, self.parts, self.held = self.whole.model, {}, 0
        self.split_ok = self._split_ok()
        self.bytes_as = self._byte_letters()

    def _split_ok(self) -> bool:
        """Whether the tokenizer's own settings say that white space only parts words, and that a word's parts don't see each other."""
        held = json.loads(self.whole.to_str())
        normal, before = ((held.get(k) or {}) for k in ("normalizer", "pre_tokenizer"))
        steps = normal.get("normalizers", [normal] if normal else [])
        splits = before.get("pretokenizers", [before] if before else [])
        self.added = [t["content"].lower().encode() for t in held.get("added_tokens") or []]
        return (
            all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in steps)
            and any(x["type"] == "Lowercase" for x in steps)
            and len(splits) == 2
            and {k: splits[0].get(k) for k in ("type", "pattern", "behavior", "invert")} == {"type": "Split", "pattern": {"Regex": PARTED}, "behavior": "Removed", "invert": True}
            and splits[1].get("type") == "ByteLevel"
            and not splits[1].get("add_prefix_space")
            and not splits[1].get("use_regex")
        )

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """The printable character that stands for each byte in byte-level vocabularies."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _of_parts(self, parts: list[str], odd: list[bool]) -> list[bytes]:
        """The ids of distinct parts, odd: for the whole library. They are remembered until MOST_BYTES are; a text's first parts are mostly its most frequent."""
        out = list(map(self.parts.get, parts))
        for i in [i for i, x in enumerate(out) if x is None]:
            text = parts[i]
            if odd[i]:
                ids = self._ids(text)
            else:
                ids = [t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(self.bytes_as.__getitem__, text.encode())))]
            out[i] = x = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.parts) < self.most and self.held < MOST_BYTES:
                self.parts[text] = x
                self.held += len(text) + len(x)
        return out

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, n): the ids of distinct words, one after the other, and how many each has."""
        raw, at = B.buffers(words)
        kind, begins = KIND[raw], np.zeros(len(raw) + 1, bool)
        begins[at] = True
        odd = np.repeat(B.per_text(kind == 0, at) > 0, np.diff(at))
        begins[1:-1] |= ~odd[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        starts = np.flatnonzero(begins[:-1])
        low = np.where(~odd & (raw >= 0x80) & (raw < 0x9F), raw + np.uint8(32), raw)  # À to Þ
        parts = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(low)]).dictionary_encode()
        index, odd_parts = parts.indices.to_numpy(), np.zeros(len(parts.dictionary), bool)
        odd_parts[index] = odd[starts]
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts.dictionary)], pa.int32()), parts.dictionary), "\n")[0].as_py().split("\n")  # no word has a line's end
        held = self._of_parts(distinct if len(parts.dictionary) else [], odd_parts.tolist())
        size = np.fromiter(map(len, held), np.int64, len(held)) // 4
        n = size[index]
        return np.frombuffer(b"".join(held), "<u4")[B.ranges((np.cumsum(size) - size)[index], n)], B.per_text(n, np.searchsorted(starts, at))

    def batch(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, at): the ids of all texts, end_id after each text's, and the place where each text's begin and the last ends.

        Arrow splits the texts and finds the distinct words; numpy lays out the ids of their occurrences. A null text is an empty one.
        """
        low = pc.ascii_lower(column.cast(pa.string()).fill_null(""))
        alone = np.full(len(low), not self.split_ok)
        for x in self.added:  # added tokens are found in the text as it is written
            alone |= pc.match_substring(low, x.decode()).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(alone), "", low) if alone.any() else low)
        words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        flat, size = self._of_words(words.dictionary)
        others = [np.array([end_id], "<u4")]
        index = np.insert(words.indices.to_numpy(), bounds[1:] - bounds[0], len(size))
        for i in np.flatnonzero(alone).tolist():  # one word, the whole text, before its end id
            index[bounds[i] - bounds[0] + i] = len(size) + len(others)
            others.append(np.array(self._ids(column[i].as_py() or ""), "<u4"))
        flat, size = np.concatenate((flat, *others)), np.concatenate((size, [len(x) for x in others]))
        n = size[index]
        ids, done = flat[B.ranges((np.cumsum(size) - size)[index], n)], np.concatenate(([0], np.cumsum(n)))
        return ids, done[np.concatenate(([0], bounds[1:] - bounds[0] + np.arange(1, len(low) + 1)))]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray, texts: np.ndarray | None = None, window: int = WINDOW, bits: int = CUT_BITS, longest: int = LONGEST) -> np.ndarray:
    """The ends of the chunks of texts that follow each other; texts: their ends, by default one.

    A cut depends on the window (a power of two) before it only, so equal passages have equal chunks inside. No window goes over a text's
    begin: a text of no more ids than a window is one chunk.
    """
    n = len(ids)
    texts = np.array([n] if texts is None else texts, np.int64)
    with np.errstate(over="ignore"):
        h, width, power = B.mix(ids.astype(np.uint64) + np.uint64(1)), 1, B.SEQ_P
        while width < window:  # of the width ids up to each place, then of twice as many
            h[width:] += power * h[:-width].copy()
            width, power = 2 * width, power * power
    hit = h >> np.uint64(64 - bits) == 0
    for i in range(window - 1):
        begins = np.concatenate(([0], texts[:-1])) + i
        hit[begins[begins < n]] = False
    hit[texts[texts > 0] - 1] = True
    ends = np.flatnonzero(hit) + 1
    gaps = np.diff(ends, prepend=0)
    more = (gaps - 1) // longest  # cuts inside gaps that are longer than a chunk may be
    if more.any():
        begin, k = np.repeat(ends - gaps, more), np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        ends = np.sort(np.concatenate((ends, begin + longest * (k + 1))))
    return ends


def merkle(digests: list[bytes]) -> bytes:
    """The root of the binary tree over digests; an odd one at a level's end goes up as it is."""
    level = list(digests) or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(b"\0" + chunk).digest()[:16]


ENCODED = "doc_id long, n_tokens long, root binary, digests array<binary>, fresh array<struct<digest: binary, n_ids: long, wide: boolean, data: binary>>"
#: A task sends a chunk's ids once, as far as it remembers so many digests.
REMEMBERED = 500_000


def unpacked(data: bytes, wide: bool) -> bytes:
    """A chunk's ids in 32 bits each, from its file's: those in 16 bits where all fit, else in 32."""
    return data if wide else np.frombuffer(data[: len(data) // 2 * 2], "<u2").astype("<u4").tobytes()


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df in a Parquet file at path, in zstd pages, read back."""
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _listed(values: pa.Array, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), values)


def _encode(path: str, end_id: int):
    def run(batches):
        own, sent = encoder(path), set()
        for batch in B.groups(batches, most=BATCH_BYTES):
            ids, at = own.batch(batch.column("text"), end_id)
            ends = cuts(ids, at[1:])
            last = np.searchsorted(ends, at[1:]) + 1  # the number of chunks up to each text's end
            wide = np.maximum.reduceat(ids, np.concatenate(([0], ends[:-1]))) > 0xFFFF
            words, halves = ids.astype("<u4").tobytes(), ids.astype("<u2").tobytes()
            bounds = [0, *ends.tolist()]
            names = [digest(words[4 * x : 4 * y]) for x, y in zip(bounds, bounds[1:], strict=False)]
            fresh, fresh_ends, first = [], [], 0
            for to in last.tolist():
                for k in range(first, to):
                    if names[k] not in sent:
                        sent.add(names[k])
                        fresh.append(k)
                fresh_ends.append(len(fresh))
                first = to
            if len(sent) > REMEMBERED:
                sent.clear()
            data = [words[4 * bounds[k] : 4 * bounds[k + 1]] if wide[k] else halves[2 * bounds[k] : 2 * bounds[k + 1]] for k in fresh]
            sizes = np.diff(ends, prepend=0)
            chunks = pa.StructArray.from_arrays([pa.array([names[k] for k in fresh], pa.binary()), pa.array(sizes[fresh], pa.int64()), pa.array(wide[fresh]), pa.array(data, pa.binary())], ["digest", "n_ids", "wide", "data"])
            lasts = last.tolist()
            roots = [merkle(names[x:y]) for x, y in zip([0, *lasts], lasts, strict=False)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(roots, pa.binary()), _listed(pa.array(names, pa.binary()), lasts), _listed(chunks, fresh_ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "root", "digests", "fresh"])

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text), each text's followed by end_id, as a store at path.

    chunks: digest, n_ids, wide, data: each distinct chunk once; data is the ids, little-endian, in 32 bits each if wide, else
    16. recipes: root (Merkle root of the digests), digests in order: one row for each distinct document. documents: part,
    doc_id, start (ids before it), n_tokens, root: in files of ascending ranges. manifest: for each part its first and last
    doc_id, n_docs, n_tokens, start, and the root of a tree over its documents in order.

    A null text is an empty one: it has the end id alone. Rows with a null doc_id come first. Repeated rows are documents
    of their own (ties go by root) with one recipe. An empty table gives empty files. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = _kept(docs.mapInArrow(_encode(tokenizer, end_id), ENCODED), scratch(spark, "encoded"))
    _kept(encoded.select(F.explode("fresh").alias("c")).select("c.*").dropDuplicates(["digest"]), f"{path}/chunks")
    encoded.select("root", "digests").dropDuplicates(["root"]).write.parquet(f"{path}/recipes")
    ranged = encoded.select("doc_id", "n_tokens", "root").repartitionByRange(width(spark), "doc_id", "root").withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    drop_written(encoded)
    parts = ranged.groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    parts = parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    inside = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_done", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(parts.select("part", F.col("start").alias("_start")), "part")
    placed = placed.select("part", "doc_id", (F.col("_start") + F.col("_done")).cast("long").alias("start"), "n_tokens", "root")
    placed.repartitionByRange(width(spark), "start").sortWithinPartitions("start").write.parquet(f"{path}/documents")
    parts.join(_parts(spark.read.parquet(f"{path}/documents")).select("part", "root"), "part").orderBy("part").write.parquet(f"{path}/manifest")


def _parts(documents: DataFrame, most: int = 256) -> DataFrame:
    """part, n_docs, n_tokens, start, root: what the documents of each part come to.

    root: of a tree over the documents' starts and roots in order, with up to `most` children to a node, so that no group is larger."""
    held = documents.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("start"))
    order = Window.partitionBy("part").orderBy("start", "root")
    level = documents.select("part", (F.row_number().over(order) - 1).alias("at"), F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.hex("root")), 256).alias("root"))
    size = held.agg(F.max("n_docs")).first()[0] or 0
    while True:
        level = level.groupBy("part", F.floor(F.col("at") / most).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "root"))).alias("x"))
        level = level.select("part", "at", F.sha2(F.concat_ws("", F.transform("x", lambda r: r["root"])), 256).alias("root"))
        size = -(-size // most)
        if size <= 1:
            return held.join(level.select("part", "root"), "part").select("part", "n_docs", "n_tokens", "start", "root")


def _chunk_facts(batches):
    schema = pa.schema([("digest", pa.binary()), ("n_ids", pa.int64()), ("crc", pa.int64()), ("sound", pa.bool_())])
    for batch in batches:
        crcs, sound = [], []
        for name, n, wide, data in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_ids", "wide", "data")), strict=True):
            chunk = unpacked(data, wide)
            crcs.append(zlib.crc32(chunk))
            sound.append(len(chunk) == 4 * n and digest(chunk) == name)
        sizes = pc.binary_length(batch.column("data")).to_numpy().astype(np.int64)
        n_ids = np.where(batch.column("wide").to_numpy(zero_copy_only=False), sizes // 4, sizes // 2)
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n_ids), pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())], schema=schema)


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, bits reflected."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


@functools.lru_cache(1 << 14)
def _shift(n_bytes: int) -> int:
    """x to the power of 8 * n_bytes."""
    out, power, n = 0x80000000, 0x00800000, n_bytes
    while n:
        if n & 1:
            out = _times(power, out)
        power = _times(power, power)
        n >>= 1
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of bytes that follow each other, from (CRC-32, number of bytes) of each."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


@functools.cache
def _by_powers() -> np.ndarray:
    """tables[k, i, b]: byte b at place i of a CRC-32, times x to the power of 8 * 2^k."""
    out, power = np.zeros((40, 4, 256), np.uint32), 0x00800000
    for table in out:
        bits = [_times(power, 1 << j) for j in range(32)]  # a product is the sum of those of its bits
        for i in range(4):
            for j in range(8):
                table[i, 1 << j : 2 << j] = table[i, : 1 << j] ^ np.uint32(bits[8 * i + j])
        power = _times(power, power)
    return out


def crcs_joined(crcs: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """crc_joined of the parts from each of bounds to the next, for all at once."""
    done = np.concatenate(([0], np.cumsum(sizes)))
    after, crc = np.repeat(done[bounds[1:]], np.diff(bounds)) - done[1:], crcs.astype(np.uint32)
    for k in range(int(after.max(initial=0)).bit_length()):
        at, table = np.flatnonzero(after >> k & 1), _by_powers()[k]
        x = crc[at]
        crc[at] = table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]
    total = np.concatenate((np.zeros(1, np.uint32), np.bitwise_xor.accumulate(crc)))
    return total[bounds[1:]] ^ total[bounds[:-1]]


def _document_facts(batches):
    schema = pa.schema([("root", pa.binary()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("sound", pa.bool_())])
    for batch in batches:
        lists = batch.column("chunks")
        bounds, chunks = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        at = chunks.field("at").to_numpy().astype(np.int64)
        text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.lexsort((at, text))
        n_ids, crcs = (chunks.field(c).fill_null(0).to_numpy()[order] for c in ("n_ids", "crc"))
        good = chunks.field("sound").to_numpy(zero_copy_only=False)[order] & (at[order] == np.arange(len(at)) - np.repeat(bounds[:-1], np.diff(bounds)))
        names, ends = chunks.field("digest").take(pa.array(order)).to_pylist(), bounds.tolist()
        whole = B.per_text(~good, bounds) == 0
        sound = [bool(ok) and merkle(names[x:y]) == root for root, ok, x, y in zip(batch.column("root").to_pylist(), whole, ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(B.per_text(n_ids, bounds)), pa.array(crcs_joined(crcs, 4 * n_ids, bounds).astype(np.int64)), pa.array(sound, pa.bool_())], schema=schema)


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of each document of a store, from its files.

    Every chunk is read, unpacked and held against its digest once, where it lies; only its CRC-32 and length go on. A
    document's CRC-32 follows from those of its chunks in the recipe's order, and so no ids are shuffled. verified: all chunks are there
    and sound, the digests have the recipe's Merkle root, the number of ids is the document's, and the documents of its part have the
    counts, start and roots of the manifest. A part without documents gives a row with a null doc_id that is not verified.
    """
    documents, recipes, chunks = (spark.read.parquet(f"{path}/{x}") for x in ("documents", "recipes", "chunks"))
    facts = chunks.mapInArrow(_chunk_facts, "digest binary, n_ids long, crc long, sound boolean")
    found = recipes.select("root", F.posexplode("digests").alias("at", "digest")).join(facts, "digest", "left")
    whole = found.groupBy("root").agg(F.collect_list(F.struct("at", "digest", "n_ids", "crc", F.coalesce("sound", F.lit(False)).alias("sound"))).alias("chunks"))
    whole = whole.mapInArrow(_document_facts, "root binary, n_ids long, ids_crc32 long, sound boolean")
    manifest, parts = spark.read.parquet(f"{path}/manifest").select("part", "n_docs", "n_tokens", "start", "root"), _parts(documents)
    held = manifest.join(parts, manifest.columns, "left_semi").select("part", F.lit(True).alias("held"))  # bounded: a row for each part
    out = documents.join(whole, "root", "left").join(F.broadcast(held), "part", "left")
    verified = F.coalesce(F.col("held") & F.col("sound") & (F.col("n_ids") == F.col("n_tokens")), F.lit(False))
    out = out.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32", verified.alias("verified"))
    lost = manifest.join(parts, "part", "left_anti")
    return out.union(lost.select(F.lit(None).cast("long"), "start", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)))


def _joined(batches):
    schema = pa.schema([("root", pa.binary()), ("ids", pa.binary())])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            own = sorted(r["chunks"] or (), key=lambda c: c["at"])
            data = [b"" if c["data"] is None else unpacked(c["data"], c["wide"]) for c in own]
            if not own or [digest(x) for x in data] != [c["digest"] for c in own] or merkle([c["digest"] for c in own]) != r["root"]:
                raise ValueError(f"recipe {r['root'].hex()}: missing or unsound chunks")
            rows.append({"root": r["root"], "ids": b"".join(data)})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document of a store. A missing recipe and missing or unsound chunks are errors."""
    documents, recipes, chunks = (spark.read.parquet(f"{path}/{x}") for x in ("documents", "recipes", "chunks"))
    found = recipes.select("root", F.posexplode("digests").alias("at", "digest")).join(chunks, "digest", "left")
    whole = found.groupBy("root").agg(F.collect_list(F.struct("at", "digest", "wide", "data")).alias("chunks"))
    out = documents.join(whole.mapInArrow(_joined, "root binary, ids binary"), "root", "left")
    ids = F.coalesce("ids", F.raise_error(F.lit("a document without its recipe")).cast("binary"))
    return out.select("doc_id", "start", "n_tokens", ids.alias("ids"))


def op3_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = scratch(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, tokenizer or default_tokenizer())
    return verify_store(spark, path)


SQL: dict[str, str] = {}
QUERIES = {"op3_token_store": op3_token_store}
