"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts is one array of code points. Each becomes a symbol: its class (letter, number, white space, other),
where one or two following characters matter (contractions, the end of white space) with those folded in. A symbol
is a transition function over eight scanner states; functions compose associatively, so blocks of symbols are
composed side by side, the blocks' functions are scanned the same way, and every character's state follows at once. State
and symbol tell whether a token piece begins there, which is what the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

does by matching. The pieces go through a cache of merged pairs to ids, which is bounded in entries and in bytes of a piece,
and which a partition's end empties. Encoded rows keep every token's byte offset, which is where decoding puts its bytes.

Null text is empty: no ids. Bytes that aren't UTF-8 are read as U+FFFD. A text longer than a step is cut where a single
space stands between two words, which always begins a piece; a text without such a place is taken whole. Repeated rows
give repeated results; an empty table gives no rows; other columns are kept by name, `n_tokens`, `ids` and `starts`
among them being replaced. The vocabulary is a file of ranks, read by each worker from the path given.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, stepwise, utf8

#: Symbols.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, SPACE, WHITE_LAST, WHITE, END = range(10)
#: States: nothing open; in letters, numbers, others, white space; behind a space that opens a piece; one or two letters of a contraction to come.
NONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, OPENED, ONE_MORE, TWO_MORE = range(8)
BLOCK, SETTLED = 32, 4
STEP = 1 << 18
#: Pieces of either of the cache's two generations; each has WIDE bytes at most, so the cache stays below some 40 MB.
CACHE = 100_000
#: Bytes of the pieces that are merged side by side, and how many at once.
WIDE, ROWS = 32, 4096
NO_RANK, NO_PAIR = np.iinfo(np.int32).max, np.iinfo(np.uint64).max
SLOT_BITS = 19


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by symbol and state."""
    to, begins = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    for state in range(8):
        for symbol, inside in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            to[symbol, state], begins[symbol, state] = inside, state not in (inside, OPENED)
        for symbol, more in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            joins = state in (IN_OTHER, OPENED)
            to[symbol, state], begins[symbol, state] = (IN_OTHER if joins else more), not joins
        for symbol in (SPACE_LAST, SPACE, WHITE_LAST, WHITE):
            to[symbol, state] = OPENED if symbol == SPACE_LAST else IN_WHITE
            begins[symbol, state] = state != IN_WHITE or symbol in (SPACE_LAST, WHITE_LAST)
        to[END, state], begins[END, state] = NONE, True
    to[LETTER, ONE_MORE], begins[LETTER, ONE_MORE] = NONE, False
    to[LETTER, TWO_MORE], begins[LETTER, TWO_MORE] = ONE_MORE, False
    return to, begins


TO, BEGINS = _automaton()


#: Ranges of code points that became letters or numbers after Unicode 16, which the pattern's engine doesn't count as such.
LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CB-A7CF A7D2 A7D4 A7DA-A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC2-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5
1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, other or white space (as WHITE) of every code point."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, symbol in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
        out[[ord(c) for c in regex.findall(pattern, every)]] = symbol
    for part in LATER.split():
        first, _, last = part.partition("-")
        out[int(first, 16) : int(last or first, 16) + 1] = OTHER
    return out


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """points: code points of texts, each followed by a cell in `ends`."""
    kind = classes()[points]
    kind[ends] = END
    follows = np.append(kind[1:], END)
    white = kind == WHITE
    last = white & (follows != WHITE) & (follows != END)
    out = kind.copy()
    space = points == 32
    out[white & last] = WHITE_LAST
    out[white & space] = SPACE
    out[white & last & space] = SPACE_LAST
    marks = np.flatnonzero(points == 39)
    marks = marks[kind[marks] == OTHER]
    one = points[np.minimum(marks + 1, len(points) - 1)]
    two = points[np.minimum(marks + 2, len(points) - 1)]
    pair = lambda a, b: (one == ord(a)) & (two == ord(b))
    out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    out[marks[pair("r", "e") | pair("v", "e") | pair("l", "l")]] = LONG
    return out


def _before(functions: np.ndarray, state: int) -> np.ndarray:
    """The state before each of n functions (n x 8), from `state` on: blocks are composed, scanned and swept."""
    n = len(functions)
    if n <= BLOCK:
        out = np.empty(n, np.uint8)
        for i in range(n):
            out[i] = state
            state = int(functions[i, state])
        return out
    rows = -(-n // BLOCK)
    padded = np.tile(np.arange(8, dtype=np.uint8), (rows * BLOCK, 1))
    padded[:n] = functions
    padded = padded.reshape(rows, BLOCK, 8)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(BLOCK):
        whole = np.take_along_axis(padded[:, k], whole, 1)
    at = _before(whole, state)
    out = np.empty((rows, BLOCK), np.uint8)
    each = np.arange(rows)
    for k in range(BLOCK):
        out[:, k] = at
        at = padded[each, k, at]
    return out.ravel()[:n]


def scan(symbol: np.ndarray) -> np.ndarray:
    """The state before every symbol, from NONE on."""
    n = len(symbol)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = TO.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(SETTLED):
        whole = flat[(grid[k].astype(np.int16) * 8)[:, None] + whole]
    same = (whole == whole[:, :1]).all(1)  # most blocks are constant functions by now: one state stands for all eight
    one, many = whole[:, 0].copy(), np.flatnonzero(~same)
    rest = whole[many]
    for k in range(SETTLED, BLOCK):
        step = grid[k].astype(np.int16) * 8
        one = flat[step + one]
        rest = flat[step[many][:, None] + rest]
    whole = np.repeat(one[:, None], 8, 1)
    whole[many] = rest
    at = _before(whole, NONE)
    out = np.empty((BLOCK, rows), np.uint8)
    for k in range(BLOCK):
        out[k] = at
        at = flat[grid[k].astype(np.int16) * 8 + at]
    return out.T.ravel()[:n]


def pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pieces of all texts in order, and how many each text has."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts])) - 1
    symbol = symbols(points, ends)
    begins = np.flatnonzero(BEGINS[symbol, scan(symbol)])
    real = symbol[begins] != END
    a, b = begins[:-1][real[:-1]], begins[1:][real[:-1]]
    counts = np.diff(np.searchsorted(a, np.concatenate(([0], ends))))
    return [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], counts


class Vocabulary:
    """Ranks of a file, the merges they imply, and the bytes of every id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.table: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.sizes = np.array([len(t) for t in self.table], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(self.table), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self._hash_pairs({(a << 32) | b: rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None})

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of pieces that the cache lacks; those of up to WIDE bytes are merged side by side and kept. A full cache becomes the older generation."""
        known, short, older = {}, [], self.older.get
        for text in missing:
            ids = older(text)
            if ids is not None:
                known[text] = ids
                continue
            raw = text.encode("utf-8")
            whole = self.ranks.get(raw)
            if whole is not None:
                known[text] = whole.to_bytes(4, "little")
            elif len(raw) <= WIDE:
                short.append((len(raw), text, raw))
            else:
                known[text] = self.merge(raw)
        short.sort(key=lambda x: x[0])
        for a in range(0, len(short), ROWS):
            rows = short[a : a + ROWS]
            for (_, text, _), ids in zip(rows, self.merge_rows([r[2] for r in rows]), strict=True):
                known[text] = ids
        for text, ids in known.items():
            if len(text) <= WIDE:
                if len(self.cache) >= CACHE:
                    self.cache, self.older = {}, self.cache
                self.cache[text] = ids
        return known

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _hash_pairs(self, pairs: dict[int, int]) -> None:
        """Tables of pairs by slot: a pair whose slot is taken goes to the next table."""
        key, rank = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        self.slots = []
        while len(key):
            keys, ranks = np.full(1 << SLOT_BITS, NO_PAIR, np.uint64), np.full(1 << SLOT_BITS, NO_RANK, np.int32)
            slot, first = np.unique(self._slot(key), return_index=True)
            keys[slot], ranks[slot] = key[first], rank[first]
            self.slots.append((keys, ranks))
            key, rank = np.delete(key, first), np.delete(rank, first)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, or NO_RANK."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, out = self._slot(key), np.full(len(key), NO_RANK, np.int32)
        for i, (keys, ranks) in enumerate(self.slots):
            if i == 0:
                out = np.where(keys[slot] == key, ranks[slot], out)
                open_ = np.flatnonzero(out == NO_RANK)
            else:
                hit = open_[keys[slot[open_]] == key[open_]]
                out[hit] = ranks[slot[hit]]
        return out

    def merge_rows(self, raw: list[bytes]) -> list[bytes]:
        """merge() of many short pieces: a row each, in every round the leftmost pair of lowest rank is joined, and links lead over the cell that goes."""
        sizes = np.array([len(r) for r in raw])
        n, wide = len(raw), int(sizes.max()) + 2  # a cell before and one behind each row
        ids = np.zeros((n, wide), np.int32)
        inside = (np.arange(wide) > 0) & (np.arange(wide) <= sizes[:, None])
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        ranks = np.full((n, wide), NO_RANK, np.int32)
        both = inside[:, 1:] & inside[:, :-1]
        ranks[:, :-1][both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        after = np.tile(np.arange(1, wide + 1, dtype=np.int8), (n, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int8), (n, 1))
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(1) if len(live) < n else ranks.argmin(1)
            low = ranks[live, at]
            go = low < NO_RANK
            live, at, low = live[go], at[go], low[go]
            gone = after[live, at].astype(np.int64)
            follows, leads = after[live, gone].astype(np.int64), before[live, at].astype(np.int64)
            ids[live, at], ids[live, gone] = low, -1
            ranks[live, gone] = NO_RANK
            after[live, at], before[live, follows] = follows, at
            right, left = follows <= sizes[live], leads > 0
            ranks[live, at] = NO_RANK
            ranks[live[right], at[right]] = self.pair_ranks(low[right], ids[live[right], follows[right]])
            ranks[live[left], leads[left]] = self.pair_ranks(ids[live[left], leads[left]], low[left])
        kept = inside & (ids >= 0)
        flat, ends = ids[kept].astype(np.uint32).tobytes(), np.cumsum(kept.sum(1)) * 4
        return [flat[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge(self, raw: bytes) -> bytes:
        """Joins the pair of lowest rank, the leftmost of equals, until none has a rank; a heap keeps long pieces near linear."""
        n, ranks = len(raw), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, j = heapq.heappop(heap)
            middle = after[i]
            if gone[i] or middle >= n or after[middle] != j:
                continue
            gone[middle] = 1
            after[i] = j
            if j < n:
                before[j] = i
                if (r := ranks.get(raw[i : after[j]])) is not None:
                    heapq.heappush(heap, (r, i, after[j]))
            k = before[i]
            if k >= 0 and (r := ranks.get(raw[k:j])) is not None:
                heapq.heappush(heap, (r, k, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : after[i]]])
            i = after[i]
        return np.array(out, np.uint32).tobytes()

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The bytes of ids; starts: where each goes."""
        sizes = self.sizes[ids]
        if not len(ids):
            return b""
        out = np.empty(int(starts[-1] + sizes[-1]), np.uint8)
        out[ragged(starts.astype(np.int64), sizes)] = self.data[ragged(self.starts[ids], sizes)]
        return out.tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def cut(text: str, most: int = STEP) -> list[str]:
    """Parts of a long text, which begin at a single space between two words."""
    out, a = [], 0
    while len(text) - a > most:
        b = text.find(" ", a + most)
        while b > 0 and (b + 1 >= len(text) or text[b - 1].isspace() or text[b + 1].isspace()):
            b = text.find(" ", b + 1)
        if b < 0:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def encode_texts(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and how many each has."""
    parts = [cut(t) for t in texts]
    slices, counts = pieces(list(chain.from_iterable(parts)))
    found = list(map(vocab.cache.get, slices))
    new = [i for i, f in enumerate(found) if f is None]
    if new:
        known = vocab.learn({slices[i] for i in new})
        for i in new:
            found[i] = known[slices[i]]
    ids = np.frombuffer(b"".join(found), np.uint32)
    by_piece = np.concatenate(([0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))) // 4
    ends = by_piece[np.cumsum(counts)][np.cumsum([len(p) for p in parts]) - 1]
    return ids, np.diff(np.concatenate(([0], ends)))


def _binary(at: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def encode_bpe(docs: DataFrame, path: str, text: str = "text", drop_text: bool = False, decoded: bool = False) -> DataFrame:
    """docs with n_tokens, ids and starts: little-endian unsigned 32-bit ids, and the byte offsets at which they begin. decoded: with `decoded` too, the bytes
    that decoding these ids gives, worked out where they were made, which saves decode_bpe's own workers."""
    made = ["n_tokens", "ids", "starts", *["decoded"] * decoded]
    docs = docs.drop(*made)
    kept = [c for c in docs.columns if not (drop_text and c == text)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in stepwise(batches, text, STEP):
            raw = utf8(part.column(part.schema.get_field_index(text))).to_pylist()
            ids, counts = encode_texts([r.decode("utf-8", "replace") for r in raw], vocab)
            at = np.concatenate(([0], np.cumsum(counts)))
            ends = np.concatenate(([0], np.cumsum(vocab.sizes[ids])))
            starts = (ends[:-1] - np.repeat(ends[at[:-1]], counts)).astype(np.uint32)
            new = [pa.array(counts), _binary(at * 4, ids), _binary(at * 4, starts)]
            if decoded:
                new.append(pa.array([vocab.decode(ids[i:j], starts[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *new], [*kept, *made])
        vocab.forget()

    types = dict(docs.dtypes)
    return docs.mapInArrow(encode, "".join(f"`{c.replace('`', '``')}` {types[c]}, " for c in kept) + "n_tokens long, ids binary, starts binary" + ", decoded binary" * decoded)


def decode_bpe(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded) of encode_bpe's rows."""
    kind = dict(encoded.dtypes)[key]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in stepwise(batches, "ids", STEP):
            rows = [vocab.decode(np.frombuffer(i, np.uint32), np.frombuffer(s, np.uint32)) for i, s in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(rows, pa.binary())], [key, "n_tokens", "ids", "decoded"])

    return encoded.select(key, "n_tokens", "ids", "starts").mapInArrow(decode, f"`{key}` {kind}, n_tokens long, ids binary, decoded binary")


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded."""
    rows = encode_bpe(docs.select("doc_id", "text"), path, drop_text=True, decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
