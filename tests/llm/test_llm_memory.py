"""Memory that the text operators' Python passes take, and their results in small parts."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmark.llm import bytesops, nearcopies, phrases, pieces, substrings, tokenstore, toxicity


def windows(rows: list[tuple[str, str]], bounds=()) -> tuple[Counter, list[int]]:
    """How often each window of four words is there, and the rows of each batch sent."""
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": x} for t, x in rows])
    sent = list(phrases._windows(np.zeros(0, np.uint64), np.array(bounds, np.int64))(iter([batch])))
    found = Counter()
    for out in sent:
        for r in out.drop_columns(["part"]).to_pylist():
            found[tuple(list(r.values())[:-1])] += r["c"]
    return found, [x.num_rows for x in sent]


def test_windows_are_sent_in_small_batches(monkeypatch):
    rows = [(" ".join(f"w{i * j % 997}" for i in range(4000)) + ". a b! a b", "en" if j % 2 else None) for j in range(1, 40)]
    whole, _ = windows(rows)
    assert sum(whole.values()) == sum(len(t.split()) for t, _ in rows)
    monkeypatch.setattr(phrases, "ROWS", 1000)
    cut, sizes = windows(rows)
    assert cut == whole and max(sizes) <= 1000 < sum(sizes)


def test_windows_add_up_over_the_parts_that_are_read():
    read = list(phrases._read(iter([pa.RecordBatch.from_pylist([{"text": "a b. c " * 60_000, "lang": x} for x in ("de", "en", "de")])]), np.zeros(0, np.uint64), phrases.B.Rolling(phrases.B.WORD_P)))
    assert len(read) == 1  # parts of a megabyte at most, folded as one group
    langs, codes, h, ahead = read[0]
    assert langs == ["de", "en"] and len(codes) == len(h) == len(ahead) == 3 * 180_000
    assert ahead[:3].tolist() == [1, 0, 2] and ahead[-1] == 0 and len(set(h.tolist())) == 6


def test_hashing_words_takes_little_memory():
    raw = np.frombuffer(b"some words " * (1 << 17), np.uint8)
    starts, ends, _ = bytesops.words(raw, np.array([0, len(raw)]))
    tracemalloc.start()
    hashed = bytesops.hash_words(raw, starts, ends, bytesops.Rolling())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - hashed.nbytes < 16 << 20 and len(set(hashed.tolist())) == 2
    assert (hashed == bytesops.hash_words(raw, starts, ends, bytesops.Rolling(), 1 << 20)).all()


TEXTS = pa.RecordBatch.from_pylist([{"doc_id": i, "text": "a b c d e f g " * 20, "terms": [0], "y": "a", "x": "a", "a": 1, "b": 2} for i in range(3)])


@pytest.mark.parametrize("run", [toxicity._terms, toxicity._held(2), nearcopies._facts(5), nearcopies._prefixes(5, np.zeros(nearcopies.BUCKETS, np.int64), 0.8), nearcopies._verified(5, 0.8), substrings._pieces(50, 16), phrases._windows(np.zeros(0, np.uint64), np.zeros(0, np.int64))])
def test_passes_give_their_memory_back(run, monkeypatch):
    calls = []
    monkeypatch.setattr(bytesops, "give_back", lambda: calls.append(1))
    list(run(iter([TEXTS.append_column("lang", pa.array(["en"] * 3))])))
    assert len(calls) == 1


def test_crcs_of_many_documents_join_at_once():
    rng = np.random.default_rng(0)
    data = [rng.bytes(4 * n) for n in (3, 0, 1, 2048, 7, 700, 1)]
    bounds = np.array([0, 3, 3, 4, 7])
    sizes = np.array([len(x) for x in data])
    got = tokenstore.crcs_joined(np.array([zlib.crc32(x) for x in data]), sizes, bounds)
    assert got.tolist() == [zlib.crc32(b"".join(data[a:b])) for a, b in zip(bounds, bounds[1:])]


def test_document_facts_of_chunks_in_any_order():
    names = [tokenstore.digest(x) for x in (b"aaaa", b"bbbb", b"cccc")]
    chunk = lambda at, k, sound=True: {"at": at, "digest": names[k], "n_ids": 1, "crc": zlib.crc32([b"aaaa", b"bbbb", b"cccc"][k]), "sound": sound}
    lost = {"at": 1, "digest": names[1], "n_ids": None, "crc": None, "sound": False}
    roots = [tokenstore.merkle(names), tokenstore.merkle(names[:2]), tokenstore.merkle(names[:2]), b"other", tokenstore.merkle([])]
    chunks = [[chunk(2, 2), chunk(0, 0), chunk(1, 1)], [lost, chunk(0, 0)], [chunk(0, 0), chunk(2, 1)], [chunk(0, 0)], []]
    kind = pa.schema([("root", pa.binary()), ("chunks", pa.list_(pa.struct([("at", pa.int32()), ("digest", pa.binary()), ("n_ids", pa.int64()), ("crc", pa.int64()), ("sound", pa.bool_())])))])
    batch = pa.RecordBatch.from_pylist([{"root": None, "chunks": [chunk(0, 0)]}] + [{"root": r, "chunks": c} for r, c in zip(roots, chunks)], schema=kind).slice(1)
    out = next(tokenstore._document_facts(iter([batch]))).to_pylist()
    assert [r["sound"] for r in out] == [True, False, False, False, True]
    assert [r["n_ids"] for r in out] == [3, 1, 2, 1, 0] and out[0]["ids_crc32"] == zlib.crc32(b"aaaabbbbcccc")


def test_a_narrow_encoder_walks_and_remembers_less(monkeypatch):
    words = [f"{a}{b}" for a in ("wonder", "Kette", "plage", "tier", "über", "x9") for b in range(30_000)]
    batch = pa.RecordBatch.from_pylist([{"text": " ".join(words[i::7]), "epoch": i, "document": str(i)} for i in range(14)] + [{"text": None, "epoch": None, "document": None}])
    walk, seen, ids = pieces.Encoder._walk, [], {}
    monkeypatch.setattr(pieces.Encoder, "_walk", lambda self, segments, keyed: seen.append((len(segments), len(self.trees.roots), self.trees.n_nodes)) or walk(self, segments, keyed))
    for narrow in (False, True):
        pieces._encoders.clear()
        seen.clear()
        ids[narrow] = [x for o in pieces._encode(pieces.default_model(), pieces.RATE, pieces.SEED, narrow)(iter([batch])) for x in o.column("ids").to_pylist()]
    most = np.array(seen).max(axis=0)
    pieces._encoders.clear()
    assert ids[True] == ids[False] and len(ids[True]) == 15 and (most <= [100_000, 100_000, 700_000]).all()


def test_the_codec_makes_its_pairs_for_long_segments_only():
    own = pieces.Codec(pieces.default_model())
    assert "pairs" not in vars(own) and own.char.dtype == np.int32
    assert own.merge_long(" " + "ab" * 50, 0, 1).tolist() == own.sp.encode("ab" * 50) and "pairs" in vars(own)


def test_the_toxicity_model_is_made_in_few_bytes_an_entry():
    rng, n, each, n_terms = np.random.default_rng(5), 400, 1000, 20_000
    own = [np.sort(rng.choice(n_terms, each, replace=False)) for _ in range(n)]
    lists = pa.array([x.tolist() for x in own], pa.list_(pa.int32()))
    counts = pa.array([rng.integers(1, 4, each).tolist() for _ in range(n)], pa.list_(pa.int32()))
    table = pa.table({"doc_id": pa.array(range(n), pa.int64()), "terms": lists, "counts": counts, "toxic": pa.array([i % 2 for i in range(n)], pa.int32())})
    held = np.bincount(np.concatenate(own), minlength=n_terms).astype(float)
    tracemalloc.start()
    model, ids = toxicity.fitted(table, held, n, {0: n, 1: n})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(n)) and model.index.first[-1] == len(model.index.weights)
    assert peak < 75 * n * each


def test_parts_of_words_go_to_the_model_and_only_odd_words_to_the_library(monkeypatch):
    own = tokenstore.Encoder(tokenstore.default_tokenizer())
    plain = ["a$$$", "Heat***", "are.***", "x1y22.5%", "(Ärger),", "ÀÝÞßÿ-naïve", "~^_`{|}", "--", "3", "é.é"]
    odd = ["it's", "'Tis", "x×y", "a÷", "µm", "Ÿ", "été", "中文1", "\x01a", "a\x7f", "a b", "ª1", "½", "a\u0085b", "🙂x", "''s", "İ", "don’t"]
    texts = [" ".join([*plain, *odd]), *plain, *odd, "", None, "  ", "a$$$\n\tit's  3", " ".join(reversed([*odd, *plain])), "x " * 50]
    monkeypatch.setattr(own, "_ids", lambda text, asked=own._ids: seen.append(text) or asked(text))
    seen: list[str] = []
    for _ in range(2):  # remembered the second time
        ids, at = own.batch(pa.array(texts), 7)
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [[*own.whole.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert sorted(seen) == sorted(tokenstore.pc.ascii_lower(pa.array(odd)).to_pylist())
    few = tokenstore.Encoder(tokenstore.default_tokenizer(), parts=3)
    assert few.batch(pa.array(texts), 7)[0].tolist() == ids.tolist() and len(few.parts) == 3
