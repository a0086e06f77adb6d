"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

A text is split at the vocabulary's added tokens, then into pieces (contractions, letters, numbers and
other characters, each with a space before it, and white space). Each different piece of a batch is merged once:
the leaves of a segment tree hold the ranks of its adjacent pairs with their places, so the root is the leftmost pair
of lowest rank. A merge changes three leaves at most and their ancestors, until the root holds no pair.
Short pieces of one batch are merged side by side, a row of a table of trees each; long ones one at a time.

Null texts count as empty and have no ids. Very long texts are handled in parts cut where pieces end whatever
follows, so memory follows the batch; one piece without any such place (a million letters) is held whole. Repeated
rows are encoded alike, an empty table gives no rows, other columns stay, whatever their names; a column named like the
result is replaced. Decoding skips null and unknown ids, and null lists give empty texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read

#: Largest vocabulary file sent to all executors, in bytes; characters of text taken at once; bytes of a piece that still
#: shares a table of trees; pieces whose ids a worker remembers.
LARGEST, AT_ONCE, SHORT, REMEMBERED = 64 << 20, 1 << 20, 64, 500_000
NONE = np.iinfo(np.int64).max
OTHER, LETTER, NUMBER, SPACE = range(4)

# The split pattern's contractions, and the letters and numbers of Unicode 16 that the
# standard library's table (15.1) does not have.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        table[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            table[a:b + 1] = kind
    table[list(WHITE)] = SPACE
    return table


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself, or the next unused from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges by rank and the bytes of every id, read from a tokenizers file. Only plain byte-level BPE is taken."""

    def __init__(self, source: str) -> None:
        doc = json.loads(source)
        model, pre = doc["model"], doc["pre_tokenizer"] or {}
        if model.get("type", "BPE") != "BPE" or doc["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(a[k] for a in doc["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that look at their neighbours")
        signs, ids = byte_signs(), model["vocab"]
        self.added = {a["content"]: a["id"] for a in doc["added_tokens"]}
        self.bytes: list[bytes | None] = [None] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(signs[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.first = np.array([ids[s] for s in sorted(signs, key=signs.get)], np.int64)  # the id of each byte
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.joined = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.known = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        self.splits = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        """Read in the driver; its size is checked, since it is sent to all executors."""
        if os.path.getsize(path) > LARGEST:
            raise ValueError(f"{path} is larger than {LARGEST} bytes")
        with open(path, encoding="utf-8") as file:
            return cls(file.read())

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it does not merge."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)


class PairTree:
    """One piece's segment tree: node 1 is the root, leaf i of the pair that starts at byte i holds rank * size + i."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes) -> None:
        n = len(piece)
        self.rank, self.joined = vocabulary.rank, vocabulary.joined
        self.ids = array("q", vocabulary.first[np.frombuffer(piece, np.uint8)].tobytes())
        self.after, self.before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        self.size = size = 1 << (n - 1).bit_length()
        self.tree = tree = array("q", [NONE]) * (2 * size)
        for i in range(n - 1):
            tree[size + i] = self.key(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def key(self, i: int) -> int:
        right = self.after[i]
        found = self.rank.get(self.ids[i] << 32 | self.ids[right]) if right < len(self.ids) else None
        return NONE if found is None else found * self.size + i

    def put(self, i: int, key: int) -> None:
        tree, at = self.tree, self.size + i
        tree[at] = key
        while at > 1:
            at >>= 1
            least = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == least:
                return
            tree[at] = least

    def merged(self) -> list[int]:
        while len(self.ids) > 1 and self.tree[1] != NONE:
            rank, i = divmod(self.tree[1], self.size)
            gone = self.after[i]
            self.ids[i], self.after[i] = int(self.joined[rank]), self.after[gone]
            if self.after[i] < len(self.ids):
                self.before[self.after[i]] = i
            self.put(gone, NONE)
            self.put(i, self.key(i))
            if self.before[i] >= 0:
                self.put(self.before[i], self.key(self.before[i]))
        out, i = [], 0
        while i < len(self.ids):
            out.append(self.ids[i])
            i = self.after[i]
        return out


def merged_rows(vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, which stay) of many pieces, a row each: a table of segment trees, every round takes all roots."""
    rows, width = ids.shape
    size = 1 << max(0, width - 2).bit_length()
    place = np.arange(width)
    after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
    stays = place < lengths[:, None]
    tree = np.full((rows, 2 * size), NONE, np.int64)
    if width > 1:
        ranks = vocabulary.ranks_of(ids[:, :-1], ids[:, 1:])
        ranks[place[1:] >= lengths[:, None]] = NONE
        tree[:, size:size + width - 1] = np.where(ranks == NONE, NONE, ranks * size + place[:-1])
    for i in range(size - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
    live = np.flatnonzero(tree[:, 1] != NONE)

    def climb(row: np.ndarray, leaf: np.ndarray) -> None:
        node = leaf + size
        while size > 1 and node[0] > 1:  # all leaves lie at one depth
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    while len(live):
        rank, i = np.divmod(tree[live, 1], size)
        gone = after[live, i]
        ids[live, i] = vocabulary.joined[rank]
        stays[live, gone] = False
        right = after[live, gone]
        after[live, i] = right
        inside = right < lengths[live]
        before[live[inside], right[inside]] = i[inside]
        new = np.full(len(live), NONE)
        found = vocabulary.ranks_of(ids[live[inside], i[inside]], ids[live[inside], right[inside]])
        new[inside] = np.where(found == NONE, NONE, found * size + i[inside])
        tree[live, size + i] = new
        last = gone < width - 1  # the leaf of the pair that began at the right part
        tree[live[last], size + gone[last]] = NONE
        left = before[live, i]
        has = left >= 0
        some, p = live[has], left[has]
        found = vocabulary.ranks_of(ids[some, p], ids[some, i[has]])
        tree[some, size + p] = np.where(found == NONE, NONE, found * size + p)
        climb(live, i)
        if last.any():
            climb(live[last], gone[last])
        if has.any():
            climb(some, p)
        live = live[tree[live, 1] != NONE]
    return ids, stays


def merge(vocabulary: Vocabulary, pieces: pa.Array) -> pa.ListArray:
    """The ids of each piece (a string array without nulls)."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8) if pieces.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece, place in it, id
    low = 1
    for width in (1, 2, 3, 5, 9, 17, 33, SHORT):
        for at in np.array_split(some := np.flatnonzero((lengths >= low) & (lengths <= width)), len(some) // 50_000 + 1):
            if len(at):
                wanted = np.minimum(offsets[at, None] + np.arange(width), len(data) - 1)
                ids, stays = merged_rows(vocabulary, vocabulary.first[data[wanted]], lengths[at])
                row, column = np.nonzero(stays)
                found.append((at[row], column, ids[row, column]))
        low = width + 1
    for at in np.flatnonzero(lengths > SHORT).tolist():
        ids = PairTree(vocabulary, data[offsets[at]:offsets[at + 1]].tobytes()).merged()
        found.append((np.full(len(ids), at), np.arange(len(ids)), np.array(ids, np.int64)))
    if not found:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(pieces) + 1, np.int32)), pa.array([], pa.int32()))
    which, place, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, which))
    ends = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(pieces)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[order], pa.int32()))


def remembered(vocabulary: Vocabulary, pieces: pa.Array) -> pa.ListArray:
    """The ids of different pieces; those that this worker has met of late are not merged again."""
    known, ids = vocabulary.known
    at = pa.compute.index_in(pieces, value_set=known)
    new = pieces.filter(at.is_null())
    if len(new):
        if len(known) + len(new) > REMEMBERED:
            known, ids, new = known.slice(0, 0), ids.slice(0, 0), pieces
        known, ids = pa.concat_arrays([known, new]), pa.concat_arrays([ids, merge(vocabulary, new)])
        at = pa.compute.index_in(pieces, value_set=known)
        vocabulary.known = known, ids
    return ids.take(at)


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start among the code points of several texts laid end to end; `first` marks the texts' first ones."""
    kind = classes()[points]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    starts = new.copy()
    # The last of several white characters before something else stands alone, or leads it if it is a space.
    white = kind == SPACE
    led = np.flatnonzero(white[:-1] & ~white[1:] & ~first[1:])
    starts[led] = True
    starts[led[points[led] == 0x20] + 1] = False
    # An apostrophe that starts a piece takes the letters of a contraction with it and ends there.
    quote = np.flatnonzero((points[:-1] == 0x27) & starts[:-1] & ~first[1:])
    for letters in CONTRACTIONS:
        at = quote[quote + len(letters) < len(points)]
        same = [points[at + 1 + k] == ord(c) for k, c in enumerate(letters)] + [~first[at + 1 + k] for k in range(len(letters))]
        at = at[reduce(np.logical_and, same)]
        starts[at + 1] = False
        beyond = at + 1 + len(letters)
        starts[beyond[beyond < len(points)]] = True
    return starts


def encode_texts(vocabulary: Vocabulary, parts: list[str | int]) -> list[pa.Array]:
    """The ids of each part: a text, or the id of an added token."""
    texts = [p for p in parts if isinstance(p, str)]
    whole = "".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    if whole:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        first[begin[sizes > 0]] = True
        at = np.flatnonzero(piece_starts(points, first))
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        byte = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        offsets = np.append(byte[at], byte[-1]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(whole.encode())).dictionary_encode()
        ids = remembered(vocabulary, pieces.dictionary).take(pieces.indices)
        count = np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy()))))
        ends = np.searchsorted(at, np.append(begin, len(points)))  # pieces before each text
        flat = ids.flatten()
    out, k = [], 0
    for part in parts:
        if isinstance(part, int):
            out.append(pa.array([part], pa.int32()))
            continue
        out.append(flat.slice(count[ends[k]], count[ends[k + 1]] - count[ends[k]]) if part else pa.array([], pa.int32()))
        k += 1
    return out


_SAFE = re.compile(r"(?<=\S)(?= \S)")


def parts_of(vocabulary: Vocabulary, text: str) -> Iterator[str | int]:
    """A text's parts that encode for themselves: added tokens, and what lies between in stretches of about AT_ONCE characters."""
    at = 0
    cuts = [(m.start(), m.end()) for m in vocabulary.splits.finditer(text)] if vocabulary.splits and any(a in text for a in vocabulary.added) else []
    for start, end in [*cuts, (len(text), len(text))]:
        while start - at > AT_ONCE and (safe := _SAFE.search(text, at + AT_ONCE, start)):
            yield text[at:safe.start()]
            at = safe.start()
        if start > at:
            yield text[at:start]
        if end > start:
            yield vocabulary.added[text[start:end]]
        at = end


def encode_array(vocabulary: Vocabulary, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, about AT_ONCE characters at a time."""
    done: list[pa.Array] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    held: list[tuple[int, str | int]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        for (row, _), ids in zip(held, encode_texts(vocabulary, [p for _, p in held]), strict=True):
            ends[row + 1] += len(ids)
            done.append(ids)
        held, size = [], 0

    for row, text in enumerate(texts):
        for part in parts_of(vocabulary, text.as_py() or ""):
            held.append((row, part))
            size += len(part) if isinstance(part, str) else 1
            if size >= AT_ONCE:
                flush()
    flush()
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.concat_arrays(done) if done else pa.array([], pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of each text as the column `out`."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return append_column(docs, out, T.ArrayType(T.IntegerType()), text_col, lambda texts: encode_array(sent.value, texts))


def decode_array(vocabulary: Vocabulary, lists: pa.Array) -> pa.Array:
    """The text of each list of ids, bytes that are no UTF-8 as U+FFFD."""
    known = pa.array(vocabulary.bytes, pa.binary())
    ids = lists.flatten()
    ids = pa.compute.if_else(pa.compute.and_(pa.compute.greater_equal(ids, 0), pa.compute.less(ids, len(known))), ids, pa.scalar(None, ids.type))
    taken = known.take(ids)
    lengths = np.concatenate(([0], np.cumsum(pa.compute.binary_length(taken).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    body = b"".join(taken.drop_null().to_pylist()) if taken.null_count else taken.buffers()[2].to_pybytes()[:lengths[-1]] if len(taken) and taken.buffers()[2] else b""
    counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    ends = lengths[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].tolist()
    return pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of each list of ids as the column `out`."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    return append_column(rows, out, T.StringType(), ids_col, lambda lists: decode_array(sent.value, lists))


def op13(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids of every document and of what they decode to. `path`: the vocabulary file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = Vocabulary.of(path)
    rows = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
