"""Byte-pair encoding and decoding with a given vocabulary.

A pre-token is a row of byte symbols. A segment tree over the ranks of adjacent pairs
holds, at its root, the leftmost pair of the lowest rank; a merge updates at most three
leaves, each in logarithmic time, until no pair can be merged. A pre-token of n bytes thus
takes O(n log n) however long it is. Frequent pieces of text are remembered in each
worker, within a fixed number of entries.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from billweave.llm.tables import with_python_columns

# Fixed value: the split pattern of byte-level vocabularies, with the white space of Unicode spelt out.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

CACHE_ENTRIES = 120_000
CACHED_LENGTH = 64
TOGETHER = 500
MANY = 64
NONE = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable ones
    stand for themselves, the others for the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    others = (b for b in range(256) if chr(b) not in letters)
    return letters | {chr(0x100 + i): b for i, b in enumerate(others)}


def merged(symbols: list[int], ranks: dict[int, int], result: list[int]) -> list[int]:
    """Apply all merges to the symbols of one pre-token, in place.

    Leaf i of the tree is the rank of the pair that begins at symbol i, with i in its low bits, so
    that of equal ranks the leftmost is least; inner nodes are minima and the root is the next
    merge. ``ranks`` has a pair's rank, ``result`` the symbol that the pair of a rank becomes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank = ranks.get
    leaves = 1 << (n - 2).bit_length()
    keys = [NONE if (r := rank(a << 20 | b)) is None else r << 32 | i
            for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
    keys += [NONE] * (leaves - n + 1)
    levels = keys
    tree = keys
    while len(levels) > 1:
        levels = [x if x < y else y for x, y in zip(levels[::2], levels[1::2], strict=True)]
        tree = levels + tree
    # tree[i - 1] is node i: the root is node 1, the children of i are 2i and 2i + 1.
    tree = [NONE, *tree]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    after[n - 1] = n
    while (least := tree[1]) != NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        new = symbols[i] = result[least >> 32]
        symbols[j] = -1
        k = after[i] = after[j]
        changed = []
        if k < n:
            before[k] = i
            changed.append((j, NONE))
            r = rank(new << 20 | symbols[k])
            changed.append((i, NONE if r is None else r << 32 | i))
        else:
            changed.append((i, NONE))
        h = before[i]
        if h >= 0:
            r = rank(symbols[h] << 20 | new)
            changed.append((h, NONE if r is None else r << 32 | h))
        for at, value in changed:
            at += leaves
            if tree[at] == value:
                continue
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    return [s for s in symbols if s >= 0]


class PairTable:
    """Ranks of symbol pairs for arrays: the pairs sorted, and those of single bytes as a square."""

    def __init__(self, ranks: dict[int, int], result: list[int], first: list[int]):
        pairs = np.fromiter(ranks.keys(), np.int64, len(ranks))
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], NONE)
        self.rank = np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], 0)
        self.result, self.first = np.array(result, np.int64), np.array(first, np.int64)
        self.of_bytes = self.keys(self.first[:, None], self.first[None, :])

    def keys(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank with seven free low bits, or FREE where a pair has no merge (symbols below 0: none)."""
        wanted = left << 20 | right
        at = np.searchsorted(self.pairs, wanted)
        return np.where((self.pairs[at] == wanted) & (right >= 0), self.rank[at] << 7, FREE)


FREE = 1 << 40


def merged_many(words: list[bytes], table: PairTable) -> list[bytes]:
    """``merged`` for many words of at most MANY bytes at once: one tree a column, all columns take
    their next merge together. Packed ids, in the order of the words."""
    out: list[bytes] = [b""] * len(words)
    groups: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        groups.setdefault(max(0, len(word) - 2).bit_length(), []).append(at)
    for bits, places in groups.items():
        leaves, width = 1 << bits, (1 << bits) + 1
        count = len(places)
        raw = np.frombuffer(b"".join([words[p].ljust(width, b"\0") for p in places]), np.uint8)
        raw = raw.reshape(count, width).T
        length = np.fromiter((len(words[p]) for p in places), np.int64, count)
        row = np.arange(width)[:, None]
        symbols = np.full((width + 1, count), -1, np.int64)  # the last row stands for "behind the end"
        symbols[:width] = np.where(row < length, table.first[raw], -1)
        tree = np.full((2 * leaves + 2, count), FREE, np.int64)  # the last two rows take what has no place
        tree[leaves:2 * leaves] = np.where(
            row[1:] < length, table.of_bytes[raw[:-1], raw[1:]] | row[:-1], FREE)
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
        after = np.minimum(row + 1, np.where(row + 1 < length, row + 1, width))
        after = np.vstack([after, np.full((1, count), width)])
        before = np.vstack([np.where(row > 0, row - 1, width) + np.zeros((1, count), np.int64),
                            np.full((1, count), width)])
        live = np.arange(count)
        while True:
            root = tree[1, live]
            going = root < FREE
            live, root = live[going], root[going]
            if not len(live):
                break
            i = root & 127
            new = table.result[root >> 7]
            j = after[i, live]
            k = after[j, live]
            h = before[i, live]
            symbols[i, live] = new
            symbols[j, live] = -1
            after[i, live] = k
            before[k, live] = i
            left = symbols[h, live]
            at_h = np.where(h < width, leaves + h, 2 * leaves + 1)
            at_j = np.minimum(leaves + j, 2 * leaves)
            tree[at_j, live] = FREE
            key = table.keys(new, symbols[k, live])
            tree[leaves + i, live] = np.where(key < FREE, key | i, FREE)
            key = table.keys(left, new)
            tree[at_h, live] = np.where((key < FREE) & (left >= 0), key | h, FREE)
            for level in range(1, bits + 1):
                for leaf in (leaves + i, at_j, at_h):
                    node = np.maximum(np.minimum(leaf, 2 * leaves - 1) >> level, 1)
                    tree[node, live] = np.minimum(tree[2 * node, live], tree[2 * node + 1, live])
        flat = symbols[:width].T
        there = flat >= 0
        packed = flat[there].astype("<u4").tobytes()
        ends = (np.cumsum(there.sum(1)) * 4).tolist()
        start = 0
        for place, end in zip(places, ends, strict=True):
            out[place] = packed[start:end]
            start = end
    return out


class Recent(dict):
    """A dictionary of bounded size: when full, its entries become the old generation, and those of
    the generation before that are forgotten unless they were asked for again."""

    def __init__(self, entries: int):
        self.entries, self.old = entries, {}

    def recall(self, key: str):
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Irregular(Exception):
    """A piece that does not begin with a visible character."""


class Pieces(Recent):
    """Ids, packed as little-endian 32-bit integers, of a space and the piece behind it."""

    def __init__(self, model: Model):
        super().__init__(CACHE_ENTRIES)
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = self.recall(piece)
        if ids is None:
            if not piece or piece[0].isspace():
                raise Irregular
            ids = self.model.plain(" " + piece)
            if len(piece) <= CACHED_LENGTH:
                self.keep(piece, ids)
        return ids


class Words(Recent):
    """Ids, packed likewise, of one pre-token."""

    def __init__(self, model: Model):
        super().__init__(CACHE_ENTRIES)
        self.first, self.ranks, self.result = model.first, model.ranks, model.result

    def __missing__(self, word: str) -> bytes:
        ids = self.recall(word)
        if ids is None:
            first = self.first
            symbols = merged([first[b] for b in word.encode()], self.ranks, self.result)
            ids = struct.pack(f"<{len(symbols)}I", *symbols)
            if len(word) <= CACHED_LENGTH:
                self.keep(word, ids)
        return ids


class Model:
    """Vocabulary and merge ranks of one byte-level file."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters, vocab = byte_letters(), data["model"]["vocab"]
        token_bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        token_bytes |= {i: token.encode() for token, i in self.special.items()}
        self.tokens = [token_bytes.get(i, b"") for i in range(max(token_bytes) + 1)]
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.ranks, self.result = {}, []
        for pair in data["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << 20 | vocab[right], len(self.result))
            self.result.append(vocab[left + right])
        self.pieces, self.words = Pieces(self), Words(self)
        self.table = PairTable(self.ranks, self.result, self.first)
        special = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def forget(self) -> None:
        """A task starts with empty caches, so a worker's memory is bounded by that of one task."""
        self.pieces.clear()
        self.words.clear()
        self.pieces.old, self.words.old = {}, {}

    def plain(self, text: str) -> bytes:
        """Ids of any text without special tokens."""
        return b"".join(map(self.words.__getitem__, PRE_TOKEN.findall(text)))

    def ordinary(self, text: str) -> bytes:
        """As ``plain``, piece by piece: no pre-token crosses a space that a visible character
        follows, so the text may be cut in front of each such space."""
        head, *pieces = text.split(" ")
        try:
            return (self.plain(head) if head else b"") + b"".join(map(self.pieces.__getitem__, pieces))
        except Irregular:
            pass
        out, run = [], [head]
        for piece in pieces:
            if piece and not piece[0].isspace():
                if run:
                    out.append(self.plain(" ".join(run)))
                    run = []
                out.append(self.pieces[piece])
            else:
                run = [*run, piece] if run else ["", piece]
        if run:
            out.append(self.plain(" ".join(run)))
        return b"".join(out)

    def learn(self, texts: list[str]) -> None:
        """Work out the unknown words of some texts together, as arrays."""
        pieces = set()
        for text in texts:
            pieces.update(text.split(" "))
        new = {p: PRE_TOKEN.findall(" " + p) for p in pieces.difference(self.pieces) if p and not p[0].isspace()}
        words = set().union(*new.values()).difference(self.words)
        words = [w for w in words if len(w) <= MANY // 4 or len(w.encode()) <= MANY]
        for start in range(0, len(words), 20_000):
            part = words[start:start + 20_000]
            for word, ids in zip(part, merged_many([w.encode() for w in part], self.table), strict=True):
                self.words.keep(word, ids)
        for piece, parts in new.items():
            if len(piece) <= CACHED_LENGTH:
                self.pieces.keep(piece, b"".join(map(self.words.__getitem__, parts)))

    def encode(self, text: str) -> bytes:
        if self.special_at is None or not self.special_at.search(text):
            return self.ordinary(text)
        return b"".join(
            struct.pack("<I", self.special[part]) if part in self.special else self.ordinary(part)
            for part in self.special_at.split(text) if part)

    def decode(self, packed: bytes) -> str:
        tokens = self.tokens
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def model(content: str) -> Model:
    return Model(content)


def vocabulary(path: str) -> str:
    """Content of a vocabulary file; the driver reads it and sends it along, so executors need no copy."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_decode(
    df: DataFrame, vocabulary_file: str, text: str = "text", with_ids: bool = False, with_text: bool = False,
) -> DataFrame:
    """Encode a text column and decode it again.

    Adds ``n_tokens`` (long), ``ids_sha256`` and ``decoded_sha256`` (hex digests of the ids as
    little-endian 32-bit integers and of the decoded text), and on demand ``ids`` (those
    bytes) and ``decoded``. Null and empty texts have no tokens and decode to the empty
    text. Rows are independent: repeated rows give equal results, an empty table gives an
    empty one. Input columns with these names are replaced. ``vocabulary_file`` is a
    byte-level vocabulary with merges; its content (about a megabyte and a half) is broadcast.
    """
    content = df.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_file))
    fields = [
        StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()), *[StructField("ids", BinaryType())] * with_ids,
        *[StructField("decoded", StringType())] * with_text,
    ]

    def start():
        bpe = model(content.value)
        bpe.forget()

        def columns(column: pa.Array) -> list[pa.Array]:
            made: list[list] = [[] for _ in fields]
            for number, value in enumerate(column):
                if number % TOGETHER == 0:
                    bpe.learn([v or "" for v in column.slice(number, TOGETHER).to_pylist()])
                packed = bpe.encode(value.as_py() or "")
                decoded = bpe.decode(packed)
                row = [len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                       hashlib.sha256(decoded.encode()).hexdigest(), *[packed] * with_ids, *[decoded] * with_text]
                for cells, cell in zip(made, row, strict=True):
                    cells.append(cell)
            types = [pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_ids, *[pa.string()] * with_text]
            return [pa.array(cells, kind) for cells, kind in zip(made, types, strict=True)]

        return columns

    return with_python_columns(df, text, fields, start)
