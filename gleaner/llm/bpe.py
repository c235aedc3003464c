"""BPE encoding and decoding with a pair occurrence index.

Texts are cut into chunks at white space (a BPE word never crosses it), and
the distinct new chunks of a block of rows are encoded together.  An index
maps each pair of symbols to all its positions among them.  The active ranks
are applied in ascending order: a rank's positions are merged at once, and
only the lists of the pairs that the merges make are updated.

Results equal those of the tokenizers library for the given file: its
normalizer, pre-tokenizer and added tokens are read from the file; truncation
and padding aren't applied.  Files whose words may cross white space, or that
have other parts than are known here, raise ValueError.

The index covers a block of the partition at a time (about BLOCK_CHARS
characters), so that memory doesn't grow with the partition.

Edge cases.  Null texts count as empty; empty texts have no ids, and no ids
decode to an empty text; null ids decode to null.  Rows that repeat, tables
without rows, and texts of any length need no special treatment: memory holds
a block of rows, its new chunks and a cache of at most CACHE_BYTES.  Other
columns are not read, so none can clash.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import input_columns, package_on_workers, read_file, released

#: Characters of text handled at once.
BLOCK_CHARS = 2_000_000
#: Bytes that a task remembers of chunks and their ids.
CACHE_BYTES = 96 << 20
#: Bytes that a remembered chunk takes beside its characters and ids.
ENTRY_BYTES = 240
#: Code points from here on stand for added tokens in the symbol table.
_ADDED = 0x200


# Fixed value: the expression of words that the known files have.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalizers that change each run between white space by itself.
NORMALIZERS = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents")


def _steps(spec: dict | None, inner: str) -> list[dict]:
    if not spec:
        return []
    return [x for part in spec[inner] for x in _steps(part, inner)] if spec["type"] == "Sequence" else [spec]


def checked(file: str) -> dict:
    """A file's content, if its texts can be encoded chunk by chunk."""
    from tokenizers import Tokenizer

    spec = json.loads(file)
    for step in _steps(spec.get("normalizer"), "normalizers"):
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        if step["type"] not in NORMALIZERS and not spaces:
            raise ValueError(f"the normalizer {step['type']} isn't read")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or t["content"].split() != [t["content"]] for t in spec["added_tokens"]):
        raise ValueError("added tokens must stand for themselves, wherever they are")
    pre = Tokenizer.from_str(file).pre_tokenizer
    words = lambda text: [w for w, _ in pre.pre_tokenize_str(text)]
    if not pre or any(words(f"{a}{c}{b}") != words(a) + words(b) for c in " \n\t\r" for a in ("ab", "1", "!", "'", "é") for b in ("cd", "2", "?", "s", "ü")):
        raise ValueError("words may cross white space")
    return spec


def _plain_words(spec: dict) -> Callable[[str], str] | None:
    """What a run of ASCII letters becomes, if it is always one word."""
    known = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
    whole = all(
        s["type"] in known or s["type"] == "ByteLevel" and not s["add_prefix_space"] or s["type"] == "Split" and s["pattern"] == {"Regex": WORDS} and s["behavior"] == "Removed" and s["invert"]
        for s in _steps(spec["pre_tokenizer"], "pretokenizers")
    )
    if not whole or any(t["content"].isascii() and t["content"].isalpha() for t in spec["added_tokens"]):
        return None
    lower = any(s["type"] == "Lowercase" for s in _steps(spec.get("normalizer"), "normalizers"))
    return str.lower if lower else str


class PairIndex:
    """Encodes chunks with the merges of a tokenizers BPE file."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        spec = checked(file)
        model = spec["model"]
        self._plain = _plain_words(spec)
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("unk_token"):
            raise ValueError("only plain BPE files with a full base alphabet are read")
        library = Tokenizer.from_str(file)
        self._normalize = library.normalizer.normalize_str if library.normalizer else lambda x: x
        self._pre = library.pre_tokenizer.pre_tokenize_str
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self._n = np.int64(max(vocab.values()) + 1)
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a] * int(self._n) + vocab[b]] = (rank, vocab[a + b])
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._rank = np.fromiter((r for r, _ in pairs.values()), np.int64, len(pairs))[order]
        size = len(model["merges"])
        self._left, self._right, self._made = (np.zeros(size, np.int64) for _ in range(3))
        self._left[self._rank], self._right[self._rank] = np.divmod(self._keys, self._n)
        self._made[self._rank] = np.fromiter((m for _, m in pairs.values()), np.int64, len(pairs))[order]
        # The lowest rank that a merge's product can take part in: where it is
        # lower than the merge's own, one place of a word is merged at a time.
        lowest = np.full(int(self._n), size, np.int64)
        np.minimum.at(lowest, self._left[self._rank], self._rank)
        np.minimum.at(lowest, self._right[self._rank], self._rank)
        self._back = lowest[self._made] < np.arange(size)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added = {text: chr(_ADDED + k) for k, text in enumerate(added)}
        self._find_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._inner = np.full(_ADDED + len(added), -1, np.int64)
        self._last = self._inner.copy()
        for text, i in vocab.items():
            if len(text) == 1 and ord(text) < _ADDED:
                self._inner[ord(text)] = i
                self._last[ord(text)] = vocab.get(text + end, -1)
        for k, i in enumerate(added.values()):
            self._inner[_ADDED + k] = self._last[_ADDED + k] = i

    def _words(self, chunk: str) -> list[str]:
        if self._plain and chunk.isascii() and chunk.isalpha():
            return [self._plain(chunk)]
        if self._find_added and (parts := self._find_added.split(chunk))[1:]:
            return [w for k, part in enumerate(parts) if part for w in ([self._added[part]] if k % 2 else self._words(part))]
        return [w for w, _ in self._pre(self._normalize(chunk))]

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of ids of each chunk."""
        words, of = [], []
        for k, chunk in enumerate(chunks):
            own = self._words(chunk)
            words += own
            of += [k] * len(own)
        if not words:
            return np.empty(0, np.int64), np.zeros(len(chunks), np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        symbol = self._inner[codes]
        symbol[ends - 1] = self._last[codes[ends - 1]]
        after, before = np.arange(1, len(codes) + 1), np.arange(-1, len(codes) - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1
        self._merge(symbol, after, before, word)
        alive = symbol >= 0
        return symbol[alive], np.bincount(np.asarray(of)[word[alive]], minlength=len(chunks))

    def _merge(self, symbol: np.ndarray, after: np.ndarray, before: np.ndarray, word: np.ndarray) -> None:
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def listed(left: np.ndarray) -> None:
            """Adds the pairs that start at these places to the index."""
            key = symbol[left] * self._n + symbol[after[left]]
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            known = self._keys[at] == key
            ranks, left = self._rank[at[known]], left[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, left = ranks[order], left[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, places in zip(ranks[np.append(0, cuts)].tolist(), np.split(left, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(places)

        listed(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self._left[rank], self._right[rank]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs, every second one from the left
                follows = np.append(False, after[at[:-1]] == at[1:])
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            if self._back[rank]:
                first = np.append(True, word[at[1:]] != word[at[:-1]])
                if not first.all():
                    index[rank] = [at[~first]]
                    heapq.heappush(active, rank)
                    at = at[first]
            gone = after[at]
            beyond = after[gone]
            symbol[at], symbol[gone] = self._made[rank], -1
            after[at] = beyond
            right = beyond >= 0
            before[beyond[right]] = at[right]
            left = before[at]
            listed(np.concatenate([left[left >= 0], at[right]]))


class _Places(dict):
    """A place for every chunk; a chunk that is asked for first gets the next."""

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        return place


class Chunks:
    """Ids of whole texts, from the ids of their distinct chunks.

    encode: gives all ids of a list of chunks, and each chunk's number of ids.
    The first chunks are remembered, as many as ``limit`` bytes hold, later
    ones for their block.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES):
        self._encode, self._left = encode, limit
        self._place = _Places()
        self._ids = np.empty(0, np.uint32)
        self._start = np.zeros(1, np.int64)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's end."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        place, flat, start = self._place, self._ids, self._start
        chunks = " ".join(texts).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        last = np.cumsum([1 + sum(map(x.count, " \n\t\r")) for x in texts]) - 1
        known = len(place)
        at = np.fromiter(map(place.__getitem__, chunks), np.int64, len(chunks))
        if new := list(islice(place, known, None)) if len(place) > known else []:
            ids, counts = self._encode(new)
            start = np.append(start, start[-1] + np.cumsum(counts))
            flat = np.append(flat, ids.astype(np.uint32))
            held = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 4 * counts + ENTRY_BYTES)
            keep = int(np.searchsorted(held, self._left, "right"))
            for chunk in new[keep:]:
                del place[chunk]
            if keep:
                self._left -= int(held[keep - 1])
                self._start, self._ids = start[: known + keep + 1].copy(), flat[: start[known + keep]].copy()
        counts = start[at + 1] - start[at]
        ends = np.cumsum(counts)
        take = np.arange(ends[-1]) + np.repeat(start[at] - ends + counts, counts)
        return flat[take], ends[last]


_kept: dict[tuple, Chunks] = {}


def kept(kind: str, file: str, encoder: Callable[[str], Callable], limit: int) -> Chunks:
    """A worker's chunks for a file, which its later tasks use too; limit: bytes."""
    key = (kind, hash(file), limit)
    if key not in _kept:
        _kept[key] = Chunks(encoder(file), limit)
    return _kept[key]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The rows in blocks of about BLOCK_CHARS characters, with their texts."""
    for batch in batches:
        begin, held, texts = 0, 0, []
        for k, text in enumerate(batch.column(column)):
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= BLOCK_CHARS or k == len(batch) - 1:
                yield batch.slice(begin, k + 1 - begin), texts
                begin, held, texts = k + 1, 0, []


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int> of every whole text; path: a tokenizers BPE file."""
    package_on_workers(docs.sparkSession)
    file = docs.sparkSession.sparkContext.broadcast(read_file(path))
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chunks(PairIndex(file.value).encode)
        for rows_of, texts in blocks(batches):
            ids, ends = own.ids(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([rows_of.column("id"), lists], names=["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids: with no decoder in the file, the
    library joins the tokens by a space and leaves out ids it doesn't know."""
    spec = json.loads(read_file(path))
    if spec.get("decoder"):
        raise ValueError("only files without a decoder are read")
    tokens = dict(map(reversed, spec["model"]["vocab"].items())) | {x["id"]: x["content"] for x in spec["added_tokens"]}
    package_on_workers(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(tokens)

    @F.pandas_udf("string")
    def joined(lists):
        get = sent.value.get
        return lists.map(lambda ids: None if ids is None else " ".join([t for t in map(get, ids.tolist()) if t is not None]))

    return rows.withColumn(out_col, joined(rows[ids_col]))
