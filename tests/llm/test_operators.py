"""Every operator against a brute-force version, on a table and on odd rows."""

import hashlib
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, exact_dedup, line_dedup, media, near_dedup, packing, queries, secrets, sharding, toxicity, url_filter
from gleaner.llm._common import tokenizer_path

from .shared import ODD, base_spans, crc, documents, frame, lines_kept, near_classes, near_copies, normal, sha, shingles


def empty(spark):
    return frame(spark, []).limit(0)


@pytest.fixture(scope="module")
def docs(sf_dir):
    return documents(sf_dir)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return lambda text: found.encode(text or "", add_special_tokens=False).ids, lambda ids: found.decode(ids, skip_special_tokens=False)


# 1: toxicity


def test_toxicity_held_out_accuracy(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, sf_dir).collect()}
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    true = dict(zip(labels["doc_id"], labels["toxic"]))
    out = [(got[i].predicted, y) for i, y in true.items() if i in got and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(out) > 50 and np.mean([p == y for p, y in out]) > 0.9
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= got[i].score <= 1 for i in got)


def test_toxicity_odd_rows(spark):
    rows = [(k, "you are an idiot and a moron" if k % 2 else "a calm and pleasant day") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows + ODD), labels)
    got = toxicity.score(frame(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert model.score("what an idiot, a moron") > 0.5 > model.score("a pleasant calm day")
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = toxicity.fit(frame(spark), labels.limit(0))
    assert none.score("x") == 0.5
    assert toxicity.score(empty(spark), model).count() == 0


def test_ngrams_are_those_of_the_whole_text():
    text = "Abcabc\né😀" * 50
    low = text.lower()
    grams = {low[k : k + n] for n in toxicity.NGRAMS for k in range(len(low) - n + 1)}
    found = toxicity.ngram_buckets(text)
    assert len(set(found.tolist())) == len(found) <= len(grams) and len(found) > len(grams) * 0.99


def bucket(gram: str) -> int:
    """As toxicity.ngram_buckets, one n-gram at a time in plain integers."""
    h, mask = 0, (1 << 64) - 1
    for n, c in enumerate(gram, 1):
        h = (h * 1_000_003 + ord(c) + n) & mask
    return ((h ^ h >> 29) * 0x9E3779B97F4A7C15 & mask) >> 64 - 20


def grams(text: str | None) -> set[int]:
    low = (text or "").lower()
    return {bucket(low[k : k + n]) for n in toxicity.NGRAMS for k in range(len(low) - n + 1)}


def test_toxicity_scores_gram_by_gram(spark, sf_dir, docs):
    """Ratios from plain counts over the labelled rows, the weights' optimum,
    and scores of whole texts, n-gram by n-gram."""
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    y = {i: t for i, t in zip(labels["doc_id"], labels["toxic"]) if zlib.crc32(str(i).encode()) % 5}
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    model = toxicity.fit(table, kept)
    text = dict(docs)
    learned = [(grams(text[i]), t) for i, t in sorted(y.items()) if i in text]
    n = Counter(t for _, t in learned)
    counts = [Counter(b for g, t in learned if t == k for b in g) for k in (0, 1)]
    ratio = {b: np.log((counts[1][b] + 1) / (n[1] + 1) / ((counts[0][b] + 1) / (n[0] + 1))) for b in counts[0] | counts[1]}
    used = np.flatnonzero(model.weights)
    assert 0 < len(used) <= 16384 and all(counts[0][b] + counts[1][b] >= 4 for b in used.tolist())
    # At the optimum the gradient of each weight is zero: it is near it.
    weight = {b: model.weights[b] / ratio[b] for b in used.tolist() if ratio[b]}
    errors = [(g, 1 / (1 + np.exp(-(model.intercept + sum(float(model.weights[b]) for b in g)))) - t) for g, t in learned]
    slope = Counter()
    for g, e in errors:
        for b in g & weight.keys():
            slope[b] += e * ratio[b] / len(learned)
    assert max(abs(slope[b] + weight[b] / len(learned)) for b in weight) < 0.05
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    for i, t in docs[::7]:
        z = model.intercept + sum(float(model.weights[b]) for b in grams(t))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_with_all_features(spark):
    rows = [(k, ("you are an idiot" if k % 2 else "a calm day") + f" number {k % 5} {k * 7919}") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    fit = lambda **kw: toxicity.fit(frame(spark, rows), labels, **kw)
    every, few = fit(features=None, min_rows=1), fit(features=20)
    assert set(np.flatnonzero(every.weights)) >= set(np.flatnonzero(few.weights)) and np.count_nonzero(few.weights) <= 20
    assert np.count_nonzero(every.weights) > np.count_nonzero(fit(features=None).weights) > 20
    assert np.allclose(every.weights, fit(features=toxicity.BUCKETS, min_rows=1).weights)
    for model in (every, few):
        assert model.score("an idiot") > 0.5 > model.score("a calm")


# 2: packing


def check_packed(rows, got, library, capacity=4096):
    need = Counter()
    for i, text in rows:
        ids = np.array(library(text) + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            need[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert need == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


def test_packing(spark, sf_dir, docs, library):
    got = queries.op2_best_fit_packing(spark, sf_dir).collect()
    bins, tokens = check_packed(docs, got, library[0])
    assert bins <= tokens / 4096 * 1.01 + 1


def test_packing_rounds_and_odd_rows(spark, library):
    rows = ODD + [(100 + k, "word " * (1 + k * 37 % 190)) for k in range(600)]
    got = packing.pack(frame(spark, rows).repartition(23), tokenizer_path(), capacity=256, fan_in=3).collect()
    bins, tokens = check_packed(rows, got, library[0], 256)
    assert bins <= tokens / 256 * 1.02 + 2
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0


def test_packing_with_and_without_carry(spark, library):
    rng = random.Random(9)
    rows = [(k, "word " * rng.choice((5, 60, 120, 130, 140, 200))) for k in range(900)]
    docs = frame(spark, rows).repartition(11).cache()
    bins = {}
    for carry in (None, 1024, 2, 0):
        got = packing.pack(docs, tokenizer_path(), capacity=256, fan_in=3, carry=carry).collect()
        bins[carry], tokens = check_packed(rows, got, library[0], 256)
    # The usual bound costs no sequence against the form without one.
    assert bins[1024] == bins[None] <= bins[2] <= bins[0]


def test_best_fit_takes_the_least_room():
    bin_of, offset, filled = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert filled.tolist() == [10, 10] and bin_of.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8]


# 3: line dedup


def test_lines_odd_rows(spark):
    more = [(20 + k, LINE) for k, LINE in enumerate(["x\n" * 3 + "a line that is long enough to count as one line"] * 2)]
    got = line_dedup.dedup_lines(frame(spark, ODD + more)).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == Counter(lines_kept(ODD + more))
    assert sum(r.n_dropped for r in got) > 6
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_table(spark, sf_dir, docs):
    got = queries.op3_line_dedup(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == Counter((i, n, d, sha(t)) for i, t, n, d in lines_kept(docs))


def test_a_long_text_of_shared_lines(spark):
    long = "\n".join(f"line number {k} of a text that is shared by all" for k in range(3000))
    rows = [(k, long) for k in range(6)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    assert [got[k].n_dropped for k in range(6)] == [3000] * 5 + [0] and got[5].text == long and got[0].text == ""


# 4: BPE


def test_bpe_equals_the_library(spark, sf_dir, docs, library):
    got = {r.doc_id: r for r in queries.op4_bpe(spark, sf_dir).collect()}
    for i, text in docs:
        ids = library[0](text)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library[1](ids)))


def test_bpe_odd_rows(spark, library):
    path = tokenizer_path()
    got = bpe.decode(bpe.encode(frame(spark), path), path).collect()
    need = Counter((i, tuple(library[0](t)), library[1](library[0](t))) for i, t in ODD)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == need
    assert bpe.encode(empty(spark), path).count() == 0
    ids = spark.createDataFrame([(None,), ([],), ([999_999, 64],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, path).collect()] == [None, "", library[1]([999_999, 64])]


def test_pair_index_on_random_strings(library):
    rng = random.Random(5)
    parts = ["a", "b", "é", "É", "e\u0301", " ", "\n", "\x1c", "\x85", "\xa0", "\u2028", "'s", "'LL", "1", "²", "Σ", "İ", "ß", "<|endoftext|>", "<|", "|>", "中", "😀", "the", "aaaa", "!!", "\x00", "٣", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["", "ab" * 999]
    with open(tokenizer_path()) as f:
        ids, ends = bpe.Chunks(bpe.PairIndex(f.read()).encode, limit=100_000).ids(texts)
    for text, begin, end in zip(texts, np.append(0, ends), ends):
        assert ids[begin:end].tolist() == library[0](text), text


def test_bpe_follows_the_file(spark):
    """Other normalizers and added tokens than the usual ones, and files whose
    texts can't be cut at white space."""
    from tokenizers import Tokenizer

    with open(tokenizer_path()) as f:
        spec = json.load(f)
    texts = ["Hello WORLD it's Abc", "ünï É é", "Token abcToken tokens", "a\tB\nc 12", "İstanbul ß"]
    lower = spec["normalizer"]["normalizers"]
    added = lambda **kw: {"id": 49408, "content": "oken", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False} | kw
    # Ids of upper case: vocab lacks most of these, which both leave out.
    files = [spec | {"normalizer": None}, spec | {"normalizer": {"type": "Sequence", "normalizers": [x for x in lower if x["type"] != "Lowercase"]}}, spec | {"normalizer": {"type": "Lowercase"}}, spec | {"added_tokens": spec["added_tokens"] + [added()]}]
    for own in files:
        text = json.dumps(own)
        library = Tokenizer.from_str(text)
        library.no_truncation()
        library.no_padding()
        for encoder in (bpe.PairIndex(text).encode, packing._library(text)):
            ids, ends = bpe.Chunks(encoder).ids(texts)
            for x, begin, end in zip(texts, np.append(0, ends), ends):
                assert ids[begin:end].tolist() == library.encode(x, add_special_tokens=False).ids, (own["normalizer"], x)
    spaces = {"type": "Split", "pattern": {"Regex": " ?[^ ]+"}, "behavior": "Isolated", "invert": False}
    for own in (spec | {"pre_tokenizer": spaces}, spec | {"normalizer": {"type": "Prepend", "prepend": "_"}}, spec | {"added_tokens": spec["added_tokens"] + [added(lstrip=True)]}, spec | {"added_tokens": spec["added_tokens"] + [added(content="a b")]}):
        with pytest.raises(ValueError):
            bpe.PairIndex(json.dumps(own))


def test_what_is_remembered_is_bounded_by_bytes():
    with open(tokenizer_path()) as f:
        encode = bpe.PairIndex(f.read()).encode
    own = bpe.Chunks(encode, limit=20_000)
    for k in range(30):
        own.ids([" ".join(f"w{k}x{j}" for j in range(40)), "y" * 3000 + str(k)])
        assert sum(len(c) + bpe.ENTRY_BYTES for c in own._place) + 4 * len(own._ids) <= 20_000
    assert own._place


# 5: exact dedup


def check_exact(rows, got):
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r.text_sha256].append(r)
    need = defaultdict(list)
    for i, text in rows:
        need[sha(normal(text))].append(i)
    assert {k: sorted((r.doc_id for r in g), key=str) for k, g in groups.items()} == {k: sorted(g, key=str) for k, g in need.items()}
    for k, g in groups.items():
        least = min((i for i in need[k] if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in g} == {(least, len(g))}
        assert [r.doc_id for r in g if r.kept] == [least]


def test_exact_odd_rows(spark):
    long = "".join(chr(97 + k % 23) for k in range(5000))
    rows = ODD + [(30, long), (31, long + "x"), (32, "y" + long[1:]), (33, long), (34, long[:4096]), (35, long[:4096] + " \n"), (36, long[:4096] + " ")]
    for block in (64, 1000, 8192):
        check_exact(rows, exact_dedup.dedup(frame(spark, rows), block=block).collect())
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_exact_when_hashes_meet(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(3)))
    rows = [(k, "block" * (k % 7) + str(k % 11)) for k in range(60)]
    check_exact(rows, exact_dedup.dedup(frame(spark, rows), block=8).collect())
    # Three blocks, and the same with a fourth one: names of blocks that were
    # looked up whole are none of those that stand for a missing neighbour.
    parts = ["aaaaaaaa", "bbbbbbbb", "cccccccc", "dddddddd"]
    rows = [(10 * k + j, "".join(parts[i] for i in order)) for k, order in enumerate([(0, 1, 2), (0, 1, 2, 3), (1, 2, 0), (1, 2, 0, 3), (3, 2, 1), (3, 2, 1, 0), (2,), (2, 0)]) for j in range(2)]
    for hashes in (1, 2, 3):
        monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c, m=hashes: F.pmod(real(*c), F.lit(m)))
        check_exact(rows, exact_dedup.dedup(frame(spark, rows), block=8).collect())


# 6: TIFF


@pytest.mark.parametrize("compression", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS])
def test_tiff_round_trip(compression):
    rng = random.Random(compression)
    for payload in (bytes(64), rng.randbytes(64 * 150), b"abc " * 16 * 400, bytes(64 * 70) + rng.randbytes(64)):
        for tile in (0, 16, 48):
            for predictor in (1, 2):
                for order in "<>":
                    file = media.write(payload, compression=compression, predictor=predictor, tile=tile, order=order, page_rows=100, strip_rows=9)
                    found = list(media.walk(file))
                    assert b"".join(p["pixels"] for p in found) == payload
                    assert len(found) == -(-len(payload) // 6400)


def test_predictors_of_wider_samples():
    values = np.arange(24, dtype="<u2").reshape(2, 4, 3) * 999
    diff = np.diff(values, axis=1, prepend=np.uint16(0))
    assert (media._undo(diff.astype(">u2").tobytes(), 2, 2, 4, 3, 16, ">") == values).all()
    floats = np.linspace(-1, 7, 10, dtype=">f4").reshape(2, 5)
    planes = np.frombuffer(floats.tobytes(), np.uint8).reshape(2, 5, 4).transpose(0, 2, 1).reshape(2, 20)
    coded = np.diff(planes, axis=1, prepend=np.uint8(0))
    assert (media._undo(coded.tobytes(), 3, 2, 5, 1, 32, "<").view("<f4").reshape(2, 5) == floats).all()


def test_tiff_odd_files(spark):
    good = media.write(bytes(range(64)) * 250, page_rows=100)
    rows = [(1, None), (2, b""), (3, good[:-20]), (4, b"II*\0\xff\xff\xff\xff"), (5, good), (None, good), (5, good)]
    got = media.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    count = Counter((r.doc_id, r.error is None) for r in got)
    assert count[(5, True)] == 6 and count[(None, True)] == 3 and count[(1, False)] == count[(2, False)] == count[(4, False)] == 1
    assert count[(3, False)] == 1


def tiff(tags: dict[int, tuple[int, ...]], data: bytes, more: bytes = b"\0\0\0\0", kind: int = 4) -> bytes:
    """A little-endian file of one directory; offsets in tags count from 8."""
    at, lists = 8 + len(data), b""
    ends = at + 2 + 12 * len(tags) + 4
    out = struct.pack("<2sHI", b"II", 42, at) + data + struct.pack("<H", len(tags))
    for tag, values in sorted(tags.items()):
        if len(values) > 1:
            out += struct.pack("<HHII", tag, kind, len(values), ends + len(lists))
            lists += struct.pack(f"<{len(values)}I", *values)
        else:
            out += struct.pack("<HHII", tag, kind, 1, values[0])
    return out + more + lists


def test_codes_from_the_formats_descriptions():
    # The examples that the descriptions of the codes give.
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    assert media.unpack_bits(packed, len(plain)) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    lzw = int(bits.ljust(88, "0"), 2).to_bytes(11, "big")
    assert media.unpack_lzw(lzw, 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_files_that_another_writer_made():
    lzw = int("".join(f"{c:09b}" for c in [256, 7, 258, 8, 8, 258, 6, 6, 257]).ljust(88, "0"), 2).to_bytes(11, "big")
    strip = tiff({256: (3,), 257: (3,), 258: (8,), 259: (5,), 262: (1,), 273: (8,), 277: (1,), 278: (3,), 279: (len(lzw),)}, lzw)
    assert next(media.walk(strip))["pixels"] == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    # Four tiles of 16 x 16 for 20 x 18 pixels: the rest of a tile is no pixel.
    image = np.arange(20 * 18, dtype=np.uint8).reshape(18, 20)
    data, offsets = b"", []
    for y in (0, 16):
        for x in (0, 16):
            offsets.append(8 + len(data))
            tile = np.full((16, 16), 255, np.uint8)
            part = image[y : y + 16, x : x + 16]
            tile[: part.shape[0], : part.shape[1]] = part
            data += zlib.compress(tile.tobytes())
    sizes = [b - a for a, b in zip(offsets, [*offsets[1:], 8 + len(data)])]
    tags = {256: (20,), 257: (18,), 258: (8,), 259: (8,), 262: (1,), 277: (1,), 322: (16,), 323: (16,), 324: tuple(offsets), 325: tuple(sizes)}
    assert next(media.walk(tiff(tags, data)))["pixels"] == image.tobytes()


def test_malformed_pages_are_rows_with_the_reason(spark):
    good = {256: (4,), 257: (4,), 258: (8,), 259: (1,), 273: (8,), 277: (1,), 278: (4,), 279: (16,)}
    tiles = {256: (4,), 257: (4,), 258: (8,), 259: (1,), 277: (1,), 322: (16,), 323: (16,), 324: (8,), 325: (256,)}
    bad = [good | {tag: (value,)} for tag in good for value in (0, 1 << 31, (1 << 32) - 1) if (tag, value) not in ((259, 0),)]
    bad += [tiles | {tag: (0,)} for tag in (256, 257, 258, 277, 322, 323)] + [good | {256: (1 << 30,), 257: (1 << 30,)}]
    files = [tiff(t, bytes(256)) for t in bad]
    files += [tiff(good | {256: (4,)}, bytes(256), kind=9).replace(struct.pack("<HHIi", 256, 9, 1, 4), struct.pack("<HHIi", 256, 9, 1, -4))]
    for k in range(4):  # cut inside the pointer to the next directory
        files.append(tiff(good, bytes(16))[: 8 + 16 + 2 + 12 * len(good) + k])
    rows = [(k, f) for k, f in enumerate(files)]
    got = defaultdict(list)
    for r in media.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(range(len(files)))
    # Rows a strip beyond the page's, and offsets of nothing, are no harm.
    fine = [k for k, t in enumerate(bad) if t.get(278, (0,))[0] >= 1 << 31]
    for k in range(len(files) - 4):
        assert len(got[k]) == 1 and (got[k][0].error is None) == (k in fine) or bad[k].get(273) == (0,) or bad[k].get(279, (0,))[0] >= 1 << 31, (k, got[k])
    for k in range(len(files) - 4, len(files)):
        assert [(r.page, r.error is None, r.pixels and bytes(r.pixels)) for r in sorted(got[k], key=lambda r: r.page)] == [(0, True, bytes(16)), (1, False, None)]
    assert media.summaries(spark.createDataFrame(rows, "doc_id long, media binary")).count() == len(files)


def feature(text: str | None) -> str:
    """Pixel by pixel, as media.feature states it."""
    data = (text or "").encode()
    data += bytes(-len(data) % 64 or (0 if data else 64))
    n, total = len(data), sum(data)
    rows = n // 64
    bits = ""
    for y in range(8):
        for x in range(8):
            cell = [data[64 * i + j] for i in range(rows * y // 8, rows * (y + 1) // 8) for j in range(8 * x, 8 * x + 8)]
            bits += "1" if sum(cell) * n > total * len(cell) else "0"
    return f"rows={rows};mean={total // n};var={sum(b * b for b in data) // n - (total // n) ** 2};ahash={int(bits, 2):016x}"


def test_tiff_query(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op6_tiff(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        data = text.encode()
        payload = data + bytes(-len(data) % 64 or (64 if not data else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.feature == feature(text)
    odd = media.summaries(media.store(frame(spark))).collect()
    assert Counter(r.doc_id for r in odd) == Counter(i for i, _ in ODD)
    assert len({(r.media_sha256, r.feature) for r in odd if r.doc_id in (1, 2)}) == 1
    assert media.summaries(media.store(empty(spark))).count() == 0


# 7: near-dedup


def check_near(rows, got, words, percent):
    need = near_classes(rows, words, percent)
    text = {}
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == need[r.doc_id] and r.kept == (r.doc_id == need[r.doc_id]), r
    for i, t in rows:
        text.setdefault(i, set()).add(len(shingles(t, words)))
    assert all(r.n_shingles in text[r.doc_id] for r in got) and len(got) == len(rows)


def test_near_table(spark, sf_dir, docs):
    check_near(docs, queries.op7_minhash_near_dedup(spark, sf_dir).collect(), 3, 85)


def test_near_odd_rows(spark):
    rows = ODD + [(50, "One two three four"), (51, "one TWO three four"), (51, "one two three four five six"), (52, "one two three four five six")]
    for words, percent in ((3, 85), (5, 80)):
        check_near(rows, near_dedup.classes(frame(spark, rows), words=words, percent=percent).collect(), words, percent)
    assert near_dedup.classes(empty(spark)).count() == 0


def test_near_large_clusters(spark, monkeypatch):
    """Clusters of several blocks, with links that only chains make."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 20)
    rows = near_copies(3, 4, 110) + [(10_000 + k, f"one of its own {k} " * 9) for k in range(20)]
    got = near_dedup.classes(frame(spark, rows), words=3, percent=85).collect()
    check_near(rows, got, 3, 85)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_near_words_that_weak_hashes_confuse(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo
    2 ** 64; nor may hashes that meet link texts, or count shingles wrongly."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"x y {word} z"), (4, f"x y {other} z"), (5, word.upper())]
    check_near(rows, near_dedup.classes(frame(spark, rows), words=3, percent=85).collect(), 3, 85)


def test_shingles_are_told_apart_where_all_hashes_meet(monkeypatch):
    from gleaner.llm import shingles as own

    monkeypatch.setattr(own._Hashes, "__missing__", lambda self, word: 7)
    monkeypatch.setattr(own, "_hashes", own._Hashes())
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(60)] + ["a b", "A  b\t", "", "a"]
    for words in (1, 3, 5):
        sets, hashes = own.shingles([own.split(t) for t in texts], words)
        need = [shingles(t, words) for t in texts]
        assert [len(s) for s in sets] == [len(n) for n in need] and max(map(len, hashes)) <= 1
        for a, x in zip(sets, need):
            for b, y in zip(sets, need):
                assert len(np.intersect1d(a, b)) == len(x & y)
    # Many different words: numbers are made dense between steps.
    texts = [" ".join(str(rng.randrange(20_000)) for _ in range(30_000)) for _ in range(2)]
    assert [len(s) for s in own.shingles([own.split(t) for t in texts], 5)[0]] == [len(shingles(t, 5)) for t in texts]


def test_near_templates_stay_apart(spark, monkeypatch):
    """One cluster of several blocks whose members are mostly not linked."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 15)
    rng = random.Random(11)
    head = " ".join(f"t{k}" for k in range(60))
    rows = [(k + 1, head + " " + " ".join(f"u{k}x{j}" for j in range(rng.choice((12, 30, 45))))) for k in range(70)]
    rows += [(1000 + k, rows[k % 9][1] + f" more{k}") for k in range(40)]
    for words, percent in ((3, 85), (5, 80)):
        check_near(rows, near_dedup.classes(frame(spark, rows), words=words, percent=percent).collect(), words, percent)


# 8: sharding


def check_shards(rows, got, shards):
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, ())) for k in range(shards)]
    assert set(slots) <= set(range(shards)) and max(counts) - min(counts) <= 1


def test_sharding(spark, sf_dir, docs, tmp_path):
    got = queries.op8_sharding(spark, sf_dir).collect()
    check_shards(docs, got, 8)
    text = dict(docs)
    assert all(r.text_crc32 == crc(text[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in got)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order) and abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15
    small = sharding.shard(frame(spark), shards=3, bucket_bytes=2000)
    check_shards(ODD, small.collect(), 3)
    assert sorted(map(str, small.collect())) == sorted(map(str, sharding.shard(frame(spark), shards=3, bucket_bytes=2000).collect()))
    few = lambda: sharding.shard(frame(spark), shards=3, bucket_bytes=2000, max_tasks=2).collect()
    check_shards(ODD, few(), 3)
    assert sorted(map(str, few())) == sorted(map(str, few()))
    assert sharding.shard(empty(spark)).count() == 0
    sharding.write(small, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ODD) and set(back.columns) >= {"shard", "slot", "text"}


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP", 4)
    rows = [(k, "x" * (k % 50)) for k in range(700)]
    check_shards(rows, sharding.shard(frame(spark, rows), shards=5, bucket_bytes=300).collect(), 5)


# 9: URL filters


def test_urls_odd_rows(spark):
    rules = queries.URL_RULES
    urls = [None, "", "nothing", "http://", "http://A.Example.NET/en/x?q#f", "http://a.example.net/enx", "https://b.org?x=/fr/", "https://b.org/fr/", "x://y.com/de/", "http://example.com/de/#", "http://net/", "http://notnet", "a://b://c.net/x", "http://bad.co.uk/1", "http://bad.co.uk/1"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)] + [(None, "http://bad.co.uk/2", None)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(13, 1), (13, 0), (14, 1), (5, 0), (None, 1), (3, None), (999, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, outcomes, rules=rules, z=0.1).collect()}
    assert [(got[k].host, got[k].path) for k in range(8)] == [("", "")] * 4 + [("a.example.net", "/en/x"), ("a.example.net", "/enx"), ("b.org", ""), ("b.org", "/fr/")]
    assert [got[k].rule for k in range(4, 13)] == ["example.net/en/", "net/", None, "org/fr/", None, "example.com/de/", "net/", None, None]
    assert (got[12].host, got[12].path) == ("b:", "//c.net/x")
    assert got[13].verdict == "block" and got[None].verdict == "block" and got[6].verdict in ("allow", "block")
    none = url_filter.judge(pages, outcomes.limit(0), rules=rules).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"}
    assert url_filter.judge(pages.limit(0), outcomes, rules=rules).count() == 0


def test_shrinkage_goes_from_suffix_to_host(spark):
    rows = [(k, f"http://h{k % 3}.d{k % 2}.com/{k}") for k in range(60)] + [(100, "http://new.d1.com/"), (101, "http://x.other.com/"), (102, "http://y.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(k, k % 2) for k in range(60)], "page_id long, bad int")
    got = {r.page_id: r.bound for r in url_filter.judge(pages, outcomes, rules={}).collect()}
    assert got[1] > got[100] > got[101] > got[0]


def test_urls_without_host_are_judged_by_all_pages(spark):
    rows = [(k, None, "u", 9) for k in range(200)] + [(1000 + k, f"http://s{k}.fine.com/", "u", 9) for k in range(19_800)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, bad int")
    outcomes = spark.createDataFrame([(i, int(u is None)) for i, u, *_ in rows], "page_id long, bad int")
    got = url_filter.judge(pages, outcomes, rules={"/": "block", "com/": "allow"}).where("page_id < 200").select("verdict", "rule", F.round("bound", 3).alias("bound")).distinct().collect()
    assert [(r.verdict, r.rule, r.bound) for r in got] == [("allow", None, 0.009)]


def test_sites(spark):
    hosts = {"u:p@a.b.co.uk:8080": ("a.b.co.uk", "b.co.uk", "co.uk"), "a.com.": ("a.com", "a.com", "com"), "10.0.0.4:81": ("10.0.0.4", "10.0.0.4", "[]"), "[::1]:80": ("[::1]", "[::1]", "[]"), "localhost": ("localhost",) * 3, "": ("", "", ""), "1.2.3.4.com": ("1.2.3.4.com", "4.com", "com")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("site", url_filter.site(F.col("host")))
    got = {r.host: (r.site, r.domain, r.suffix) for r in rows.select("host", "site", url_filter.domain(F.col("site")).alias("domain"), url_filter.suffix(F.col("site")).alias("suffix")).collect()}
    assert got == hosts


def test_strength_is_learned(spark):
    """Hosts that are all bad or all good say more by one page than hosts that
    are alike."""
    bounds = []
    for bad in (lambda host, page: host % 2, lambda host, page: page % 2):
        rows = [(100 * h + p, f"http://h{h}.x{h}.com/{p}", bad(h, p)) for h in range(40) for p in range(10)]
        rows += [(9001, "http://new.fresh.com/", 1)]
        pages = spark.createDataFrame(rows, "page_id long, url string, seen int")
        outcomes = pages.select("page_id", F.col("seen").alias("bad"))
        bounds.append({r.page_id: r.bound for r in url_filter.judge(pages, outcomes, rules={}).collect()})
    assert bounds[0][100] > 0.75 > 0.25 > bounds[0][200]
    assert abs(bounds[1][100] - bounds[1][200]) < 0.01 and bounds[0][9001] != bounds[1][9001]


def test_many_rules(spark):
    rules = {f"h{k}.com/p{k % 7}": "block" if k % 2 else "allow" for k in range(3000)} | {"com/": "allow", "com/p1": "block", "h1.com/": "block"}
    urls = [(k, f"http://w.h{k % 50}.com/p{k % 9}/x") for k in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    table = spark.createDataFrame(list(rules.items()), "rule string, verdict string")

    def need(host, path):
        fits = [r for r in rules if (host + "/").startswith(r.split("/")[0] + "/") or host.endswith("." + r.split("/")[0])]
        return max((r for r in fits if path.startswith("/" + r.split("/", 1)[1])), key=lambda r: (len(r), r))

    for given in (rules, table):
        for r in url_filter.judge(pages, spark.createDataFrame([], "page_id long, bad int"), rules=given).collect():
            assert (r.rule, r.verdict) == (need(r.host, r.path), rules[need(r.host, r.path)])


# 10: secret scans


def test_secrets_odd_rows(spark):
    tricky = [
        (60, "token=secret=abcdefghij secret: token: abcdefghij"),
        (61, "PassWord\"  :  'abcd' passwd=12345678"),
        (62, "f" * 31 + " " + "0" * 32 + "g" + "a" * 40 + " AKIA" + "Z" * 11 + " AKIAZAKIA" + "Z" * 12),
        (63, "😀" * 5 + "api_key='" + "x" * 9 + "' apikey=" + "y" * 8),
        (64, " ".join(f"token={k:08d}" for k in range(700))),
        (65, "to\u212aen=abcdefghij pa\u017f\u017fword=abcdefghij"),
        (66, "ghp_" + "a1B2" * 9 + " xoxb-123456789012-abcdef"),
    ]
    rows = ODD + tricky
    got = secrets.scan(frame(spark, rows)).collect()
    base = lambda s: [f"{x.kind}:{x.start}:{x.end}" for x in s if x.kind in ("assign", "access", "hex")]
    assert Counter((r.doc_id, tuple(base(r.spans))) for r in got) == Counter((i, tuple(base_spans(t))) for i, t in rows)
    assert [x.kind for r in got if r.doc_id == 66 for x in r.spans] == ["github", "slack"]
    assert secrets.scan(empty(spark)).count() == 0
    cut = {r.doc_id: r.t for r in secrets.scan(frame(spark, rows)).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert cut[66] == "[secret] [secret]" and cut[4] == "two words" and cut[64] == " ".join(["[secret]"] * 700)


def test_marks_in_place_of_spans_that_overlap(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        n = rng.choice((0, 1, 5, 700))
        text = "".join(rng.choice("aé😀") for _ in range(2000))
        found = sorted((a, rng.randrange(4), a + rng.randrange(1, 12), "x") for a in (rng.randrange(1980) for _ in range(n)))
        rows.append((k, text, found))
    got = spark.createDataFrame(rows, "doc_id int, text string, spans array<struct<start: int, order: int, end: int, kind: string>>")
    got = {r.doc_id: r.t for r in got.select("doc_id", secrets.redacted(F.col("text"), F.col("spans"), "#").alias("t")).collect()}
    for k, text, found in rows:
        out, at = "", 0
        for start, _, end, _ in found:
            if end > at:
                out, at = out + text[at : max(at, start)] + "#", end
        assert got[k] == out + text[at:]


def test_secrets_table(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op10_secret_scan(spark, sf_dir).collect()}
    for i, text in docs:
        need = base_spans(text)
        assert got[i].base_sha256 == sha(",".join(need)), (i, need, got[i].spans)
        assert got[i].n_assign + got[i].n_access + got[i].n_hex == len(need)
        assert set(need) <= set(got[i].spans.split(","))
    assert sum(len(base_spans(t)) for _, t in docs) > 5


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("[0-9a-f]+") == secrets.ANY
    assert q("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert set(q("(foo|ba?r)x")) == {frozenset({"foo", "oox"}), frozenset({"bar", "arx"}), frozenset({"brx"})}
    assert q("ab?c") == secrets.ANY and q("(ab|cde)+") == secrets.ANY
    assert set(q("x(abc|def)+[0-9]*ghi")) >= {frozenset({"abc", "ghi"})}
    assert q(r"\x41b\.c{2}[]x-]d") == [frozenset({"ab.", "b.c", ".cc", f"cc{c}", f"c{c}d"}) for c in "-]x"]
    assert q(r"(?:one|\d+)two|[^a]three") == [frozenset({"two"}), frozenset({"thr", "hre", "ree"})] and q("ab|c") == secrets.ANY
    assert q("(abcd){0,2}") == secrets.ANY and q("(abcd){2,}x*?") == [frozenset({"abc", "bcd"})]
    for bad in ("(ab", "a)", "[ab", "a{x}", "^a", "(?i)a", r"\1a", "*a", "a\\"):
        with pytest.raises(ValueError):
            q(bad)
    for rule in secrets.BASE + secrets.ADDED:
        for text in ("password: 12345678", "API_KEY=abcdefgh", "AKIA" + "A1" * 8, "ghp_" + "a" * 36):
            if re.search(rule.pattern, text, re.I):
                low = text.lower()
                assert any(all(g in low for g in s) for s in q(rule.pattern))
