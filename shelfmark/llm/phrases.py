"""Phrase collocations: windows of four words are counted once, and a ROLLUP over their columns sums the shorter phrases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import bytesops as B
from shelfmark.llm.bitmaps import bitmap, maybe_in
from shelfmark.llm.session import ready
from shelfmark.shared import drop_written, table, width, written

#: Phrases of up to LONGEST words, found LEAST times or more; one goes if a longer one has KEPT percent of its places. TOP of each language are returned.
LONGEST, LEAST, KEPT, TOP = 4, 30, 80, 2000
#: Rows that a task folds at once. SALTS: into how many parts a language is ranked first.
CHUNK, SALTS = 100_000, 64
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of text whose equal windows a task adds up before it sends them, and rows that it sends at once.
FOLDED, ROWS = 8 << 20, 50_000
#: Distinct words that a task knows it has sent already.
REMEMBERED = 500_000


def _tokens(batch: pa.RecordBatch, clashing: np.ndarray, rolling: B.Rolling):
    """(codes, langs, hashes, joined, raw, starts, ends): of each word its language's number, its hash, whether the next one is in the same piece, and its bytes.

    A hash is of language and word, and never 0. Words whose hash is among `clashing` get the next of a row of hashes."""
    raw, at = B.buffers(batch.column("text"))
    raw = B.lower(raw)
    stop = np.zeros(256, bool)
    stop[list(BREAKS)] = True
    inside = ~stop
    inside[[0x20, 9]] = False
    starts, ends, first = B.words(raw, at, inside)
    coded = batch.column("lang").fill_null("und").dictionary_encode()
    langs, codes = coded.dictionary.to_pylist(), np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(first))
    salt = np.array([xxhash.xxh64_intdigest(x) for x in langs], B.U64)
    with np.errstate(over="ignore"):
        h = B.mix(B.hash_words(raw, starts, ends, rolling) + salt[codes] * B.SEQ_P)
    again, seed = np.flatnonzero(np.isin(h, clashing)) if len(clashing) else [], 0
    while len(again):
        seed += 1
        h[again] = [xxhash.xxh64_intdigest(langs[codes[i]].encode() + b" " + raw[starts[i] : ends[i]].tobytes(), seed) for i in again]
        again = again[np.isin(h[again], clashing)]
    h[h == 0] = 1
    stops = np.searchsorted(np.flatnonzero(stop[raw]), starts)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    joined = (stops[1:] == stops[:-1]) & (text[1:] == text[:-1])
    return codes, langs, h, joined, raw, starts, ends


COUNTED = "lang string, h1 long, h2 long, h3 long, h4 long, c long"
#: The share of documents that tells where ranges begin. It moves work between tasks and changes no result.
SAMPLE = 0.02


def _pair(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """What rows are sorted by first: the upper halves of the first two words' hashes."""
    return (h1 & B.U64(0xFFFFFFFF00000000) | h2 >> B.U64(32)).view(np.int64)


#: The same as a Column expression.
PAIR = "h1 & -4294967296L | shiftrightunsigned(h2, 32)"


def _pairs(clashing: np.ndarray):
    """(s): the pair of each place of the texts."""

    def run(batches):
        rolling = B.Rolling(B.WORD_P)
        for batch in B.groups(batches):
            _, _, h, joined, *_ = _tokens(batch, clashing, rolling)
            second = np.zeros(len(h), B.U64)
            second[:-1][joined] = h[1:][joined]
            yield pa.RecordBatch.from_arrays([pa.array(_pair(h, second))], names=["s"])

    return B.returning(run)


def _ranges(bounds: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """The range of each window: by its pair between bounds; a pair that is a bound, once or more often, is dealt to the ranges it lies in by its other words."""
    s = _pair(cols[:, 0], cols[:, 1])
    out = np.searchsorted(bounds, s, side="left")
    at = np.flatnonzero(out < np.searchsorted(bounds, s, side="right"))
    with np.errstate(over="ignore"):
        rest = B.mix(cols[at, 2] * B.SEQ_P + cols[at, 3]) >> B.U64(32)
    wide = (np.searchsorted(bounds, s[at], side="right") - out[at] + 1).astype(B.U64)
    out[at] += (rest * wide >> B.U64(32)).astype(out.dtype)
    return out


def _rows(langs: list[str], r: np.ndarray) -> pa.RecordBatch:
    lang = pa.DictionaryArray.from_arrays(pa.array(r[:, 0].astype(np.int32)), pa.array(langs, pa.string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, *[pa.array(np.ascontiguousarray(r[:, i])) for i in range(1, 6)]], names=["lang", "h1", "h2", "h3", "h4", "c"])


def _read(batches, clashing: np.ndarray, rolling: B.Rolling, most: int = FOLDED):
    """(langs, codes, hashes, ahead) of the words of groups of texts, about `most` bytes each: what _tokens has, read in small parts of which only this stays; ahead: how many words, 3 at most, follow in the same piece."""
    names: dict[str, int] = {}
    parts, size = [], 0
    for batch in B.groups(batches):
        codes, langs, h, joined, raw, *_ = _tokens(batch, clashing, rolling)
        size += len(raw)
        to = np.array([names.setdefault(x, len(names)) for x in langs] or [0], np.int32)
        ahead, on = np.zeros(len(h), np.int8), np.ones(len(h), bool)
        for k in range(1, LONGEST):
            on[: max(0, len(h) - k)] &= joined[k - 1 :]
            on[max(0, len(h) - k) :] = False
            ahead += on
        parts.append((to[codes], h, ahead))
        del codes, h, joined, raw, on
        if size >= most:
            yield list(names), *map(np.concatenate, zip(*parts, strict=True))
            parts, size = [], 0
    if parts:
        yield list(names), *map(np.concatenate, zip(*parts, strict=True))


def _windows(clashing: np.ndarray, bounds: np.ndarray):
    """The window of four words from each word on, with 0 after the end of its piece, how often a group of texts has it, and its range; like windows lie together.

    Windows stay places of their first words. Their columns are made one at a time to compare them, and for ROWS of them to send."""

    def run(batches):
        for langs, codes, h, ahead in _read(batches, clashing, B.Rolling(B.WORD_P)):
            n = len(h)
            if not n:
                continue

            def column(at: np.ndarray, k: int, h=h, ahead=ahead) -> np.ndarray:
                return np.where(ahead[at] >= k, h[np.minimum(at + k, len(h) - 1)], B.U64(0))

            key = h
            with np.errstate(over="ignore"):
                for k in range(1, LONGEST):
                    key = B.mix(key * B.SEQ_P + column(np.arange(n), k))
            order = np.argsort(key)
            # the key rules equal windows in; the columns decide
            new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
            del key
            for k in range(LONGEST):
                x = column(order, k)
                new[1:] |= x[1:] != x[:-1]
            at = np.flatnonzero(new)
            own, count = order[at], np.diff(np.append(at, n))
            del order, new, at, x
            near = np.argsort(_pair(h[own], column(own, 1)))
            for i in range(0, len(near), ROWS):
                some = own[near[i : i + ROWS]]
                cols = np.column_stack([column(some, k) for k in range(LONGEST)])
                rows = _rows(langs, np.column_stack((codes[some], cols.view(np.int64), count[near[i : i + ROWS]])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(_ranges(bounds, cols).astype(np.int32))], names=[*rows.schema.names, "part"])

    return B.returning(run)


def _changes(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)) if len(key) else np.zeros(0, int)


def _begins(r: np.ndarray, k: int) -> np.ndarray:
    """Where the language and the first k words change."""
    return _changes(r[:, : k + 1])


def _halves(r: np.ndarray, size: int) -> np.ndarray:
    """The upper halves of the first words: rows are in their order, so that only by them one word's rows surely lie together."""
    return r[:, 1 : size + 1] >> 32


def _folded(r: np.ndarray) -> np.ndarray:
    at = _begins(r, LONGEST)
    out = r[at]
    if len(r):
        out[:, 5] = np.add.reduceat(r[:, 5], at)
    return out


def _shortened(r: np.ndarray, least: int, levels: range, open_keys: set[tuple]) -> np.ndarray:
    """The k-th words on (k in levels) become 0 where the first k are found fewer than `least` times. Rows whose upper halves are in open_keys may have others elsewhere: of them only whole windows are judged."""
    r = _folded(r)
    halves = {size: _halves(r, size) for size in {len(x) for x in open_keys}}
    shut = np.ones(len(r), bool)
    for key in open_keys:
        shut &= ~(halves[len(key)] == key).all(axis=1)
    for k in levels:
        at = _begins(r, k) if k > 1 else _changes(_halves(r, 1))
        rare = np.repeat(np.add.reduceat(r[:, 5], at) < least, np.diff(np.append(at, len(r))))
        r[rare & shut if k < LONGEST else rare, k:5] = 0
    return _folded(r)


def _stepped(chunks, least: int, size: int, levels: range):
    """Sorted rows shortened at `levels`, without holding more than a chunk and one group of `size` words.

    The last group of a chunk waits for the next chunk. One that alone is over a chunk is found often enough; it goes on in parts
    and stays open, as do the first and the last group, which the tasks of the ranges beside may share."""
    held, open_keys, first = np.zeros((0, 6), np.int64), set(), True
    for chunk in chunks:
        held = np.concatenate((held, chunk))
        key = _halves(held, size)
        if first:
            open_keys.add(tuple(key[0]))
            first = False
        cut = _changes(key)[-1]
        if len(held) - cut > CHUNK:
            open_keys.add(tuple(key[-1]))
            cut = _begins(held, LONGEST)[-1]
        if cut:
            yield _shortened(held[:cut], least, levels, open_keys)
        held = held[cut:] if cut or len(held) <= CHUNK else _folded(held)
        open_keys &= {tuple(_halves(held, size)[0])}
    if len(held):
        yield _shortened(held, least, levels, open_keys | {tuple(_halves(held, size)[-1])})


def _reduced(least: int):
    """Rows in the order of PAIR and h1 to h4: equal windows are added up, and words that no phrase of `least` places can have are cut off."""

    def run(batches):
        names: dict[str, int] = {}

        def chunks():
            waiting, n = [], 0
            for batch in batches:
                coded = batch.column("lang").dictionary_encode()
                to = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()] or [0], np.int64)
                waiting.append(np.column_stack((to[coded.indices.to_numpy(zero_copy_only=False)], *[batch.column(i).to_numpy() for i in range(1, 6)])))
                n += batch.num_rows
                if n >= CHUNK:
                    yield np.concatenate(waiting)
                    waiting, n = [], 0
            if n:
                yield np.concatenate(waiting)

        for r in _stepped(_stepped(chunks(), least, 2, range(LONGEST, 1, -1)), least, 1, range(1, 0, -1)):
            yield _rows(list(names), r)

    return B.returning(run)


def _vocabulary(clashing: np.ndarray, bits: bytes):
    def run(batches):
        rolling, other = B.Rolling(B.WORD_P), B.Rolling(B.SEQ_P)
        schema = pa.schema([("h", pa.int64()), ("of", pa.string()), ("word", pa.string())])
        sent = np.zeros(0, B.U64)
        for batch in B.groups(batches):
            codes, langs, h, _, raw, starts, ends = _tokens(batch, clashing, rolling)
            # a second hash keeps words of one hash apart
            both, own = np.unique(h ^ B.mix(B.hash_words(raw, starts, ends, other)), return_index=True)
            new = maybe_in(bits, h[own]) & ~np.isin(both, sent, assume_unique=True)
            own, sent = own[new], np.concatenate((sent if len(sent) < REMEMBERED else sent[:0], both[new]))
            words = [raw[a:b].tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array([langs[x] for x in codes[own].tolist()], pa.string()), pa.array(words, pa.binary()).cast(pa.string())], schema=schema)

    return B.returning(run)


def phrase_counts(docs: DataFrame, least: int = LEAST, clashing: frozenset[int] = frozenset()) -> tuple[DataFrame, DataFrame]:
    """docs (text, lang) -> two written tables: (lang, p, f), the phrases p (hashes of 1 to 4 words) with f >= least places, and with an empty p all words of the language; (h, of, word), their words.

    Windows are dealt to ranges of pairs of words and sorted there; a hot word spreads over ranges, and so does a hot pair, by its
    other words. In a range equal windows meet and what can't reach `least` is cut off; ROLLUP sums the windows' columns to the
    shorter phrases. If two words of phrases share a hash, all is counted again with other hashes for those."""
    spark = docs.sparkSession
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    clash = np.array(sorted(clashing), B.U64)
    columns = ["h1", "h2", "h3", "h4"]
    n = 2 * width(spark)
    cuts = F.percentile_approx("s", [i / n for i in range(1, n)], 20 * n)
    bounds = np.array(docs.sample(SAMPLE, seed=1).mapInArrow(_pairs(clash), "s long").agg(cuts).first()[0] or [], np.int64)
    ranges = docs.mapInArrow(_windows(clash, bounds), f"{COUNTED}, part int").repartitionById(n, F.col("part")).drop("part").sortWithinPartitions(F.expr(PAIR), *columns)
    summed = ranges.mapInArrow(_reduced(least), COUNTED).rollup("lang", *columns).agg(F.sum("c").alias("f"), F.grouping_id().alias("g"))
    k = F.when(F.col("g") == 31, -1).otherwise(sum((F.col("g") == v).cast("int") * i for i, v in enumerate((15, 7, 3, 1, 0))))
    phrase = F.slice(F.array(*columns), F.lit(1), F.greatest(F.lit(0), F.col("k")))
    full = (F.col("k") == 0) | ((F.col("k") > 0) & (F.col("f") >= least) & (F.element_at(F.array(*columns), F.greatest(F.lit(1), F.col("k"))) != 0))
    counts = written(summed.withColumn("k", k).filter(full).select("lang", phrase.alias("p"), "f"), "phrases")
    often = counts.filter("size(p) = 1").select(F.col("p")[0].alias("h"))
    words = written(docs.mapInArrow(_vocabulary(clash, bitmap(often.select(F.col("h").alias("key")))), "h long, of string, word string").join(often, "h").distinct(), "phrase-words")
    twice = [r.h % (1 << 64) for r in words.groupBy("h").count().filter("count > 1").select("h").toLocalIterator()]
    if twice:  # about (number of words)^2 / 2^65
        drop_written(counts)
        drop_written(words)
        return phrase_counts(docs, least, clashing | set(twice))
    return counts, words


def _parts(counts: DataFrame, key: str, value: str) -> DataFrame:
    return counts.filter("size(p) > 0").select(F.col("p").alias(key), F.col("f").alias(value))


def collocations(docs: DataFrame, least: int = LEAST, kept: int = KEPT, top: int = TOP) -> DataFrame:
    """docs (text, lang) -> (lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to 4 words of each language.

    A phrase found a >= least times scores floor(2000000 * a / (l + r)) by its worst cut into a first part (l places) and a rest (r places). It is dropped if a
    longer phrase of at least `least` places has kept percent of its places or more. Order: score, then a, descending, then phrase. n: all words of the language.

    Null texts are empty; a null lang is und. Repeated rows count like others. An empty table, or one without such phrases, gives no
    rows. Only text and lang are read."""
    counts, words = phrase_counts(docs, least)
    cuts = counts.filter("size(p) > 1").select("lang", "p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("j"))
    cuts = cuts.select("*", F.slice("p", F.lit(1), F.col("j")).alias("first"), F.slice("p", F.col("j") + 1, F.size("p") - F.col("j")).alias("rest"))
    cuts = cuts.join(_parts(counts, "first", "l"), "first").join(_parts(counts, "rest", "r"), "rest")
    score = F.expr("CAST(CAST(a AS DECIMAL(20, 0)) * 2000000 DIV (l + r) AS BIGINT)")
    best = cuts.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("s")).select("lang", "p", "a", "s.*")
    inner = F.expr("flatten(transform(sequence(2, size(p) - 1), m -> transform(sequence(1, size(p) - m + 1), i -> slice(p, i, m))))")
    over = counts.filter("size(p) > 2").select(F.explode(inner).alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    left = best.join(over, "p", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < kept * F.col("a")))
    order = [F.col("score").desc(), F.col("a").desc()]
    left = left.withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)))
    some = left.withColumn("_k", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("_k") <= top)
    some = some.withColumn("_k", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_k") <= top).drop("_k", "salt", "longer", "j")
    some = written(some, "phrases-top")
    spelled = some.select("p", F.posexplode("p").alias("at", "h")).join(words, "h").groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    all_words = counts.filter("size(p) = 0").select("lang", F.col("f").alias("n"))
    out = some.join(spelled, "p").join(all_words, "lang")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark, ROWS)
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = {
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
u AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS j FROM c),
x AS (SELECT u.lang, u.phrase, u.a, u.j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * u.a) // (l.f + r.f) AS BIGINT) AS score FROM u
  JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:j], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
s AS (SELECT lang, a, ws, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
o AS (SELECT lang, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, max(a) AS longer FROM s GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
}
QUERIES = {"op12_collocations": op12_collocations}
