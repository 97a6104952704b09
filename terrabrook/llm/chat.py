"""Chat formatting by columnar byte assembly.

A turn becomes  `<s>` role `[INST]` text `</s>`, conversations are the turns in order. Inside role and text a
backslash is put behind every `<`, `[` and backslash, so no control string can occur there, and removing the
second byte of each such pair gives the text back. For a batch the segment lengths, their running sums and the
scatter indices are numpy arrays; fixed strings and contents are copied into one preallocated Arrow buffer.
The loss mask covers the texts of the assistant as byte spans of the formatted bytes.

One shuffle brings the turns of a conversation together in order; a stream of bounded batches then formats them,
so a conversation of any length passes in pieces (`part`), each a whole number of turns. Null text or role: empty. Null
conv_id: one conversation. Null turn comes first; rows with equal turn go by role and text; repeated rows are turns.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, ragged, steps, utf8

OPEN, BODY, CLOSE = b"<s>", b"[INST]", b"</s>"
SPECIAL = np.zeros(256, bool)
SPECIAL[[ord("<"), ord("["), ord("\\")]] = True


def _lists(flat: pa.Array, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)


def escape(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes with a backslash behind each special byte."""
    hit = SPECIAL[data]
    moved = np.concatenate(([0], np.cumsum(hit)))
    out = np.full(len(data) + int(moved[-1]), ord("\\"), np.uint8)
    out[np.arange(len(data)) + moved[:-1]] = data
    return at + moved[at], out


def unescape(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: in a run of special bytes, which lies in one segment, every second one was put in."""
    hit = SPECIAL[data]
    place = np.arange(len(data))
    start = hit.copy()
    start[1:] &= ~hit[:-1]
    bounds = at[(at > 0) & (at < len(data))]
    start[bounds] = hit[bounds]
    since = place - np.maximum.accumulate(np.where(start, place, 0))
    keep = ~(hit & (since % 2 == 1))
    kept = np.concatenate(([0], np.cumsum(keep)))
    return kept[at], data[keep]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of turns: offsets of the formatted turns, their bytes, and each text's start and end in them."""
    (ra, rd), (ta, td) = escape(*buffers(roles)), escape(*buffers(texts))
    n = len(ra) - 1
    sizes = np.empty((n, 5), np.int64)  # the five segments of a turn
    sizes[:] = [len(OPEN), 0, len(BODY), 0, len(CLOSE)]
    sizes[:, 1], sizes[:, 3] = np.diff(ra), np.diff(ta)
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, OPEN), (2, BODY), (4, CLOSE)):
        out[(starts[:, k, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    out[ragged(starts[:, 1], sizes[:, 1])] = rd
    out[ragged(starts[:, 3], sizes[:, 3])] = td
    return np.concatenate(([0], ends[:, 4])) if n else np.zeros(1, np.int64), out, starts[:, 3], ends[:, 3]


FORMATTED = "first boolean, part int, n_turns long, formatted binary, loss_start array<long>, loss_end array<long>"


def format_chats(turns: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, first, part, n_turns, formatted, loss_start, loss_end) of each part of a conversation, in order within its partition.

    `first` marks a conversation's first part. Spans are byte offsets in the part.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, begun = None, 0, False
        for batch in batches:
            texts = utf8(batch.column(2))
            for a, b in steps(buffers(texts)[0]):
                ids = batch.column(0).slice(a, b - a)
                roles = utf8(batch.column(1).slice(a, b - a))
                at, out, low, high = assemble(roles, texts.slice(a, b - a))
                values, null = pc.fill_null(ids, 0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
                new = np.ones(b - a, bool)
                new[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
                cut = np.append(np.flatnonzero(new), b - a)
                firsts, parts = np.ones(len(cut) - 1, bool), np.zeros(len(cut) - 1, np.int32)
                if begun and (values[0], null[0]) == last:
                    part += 1
                    firsts[0], parts[0] = False, part
                if len(cut) > 2 or firsts[0]:
                    part = 0
                last, begun = (values[-1], null[-1]), True
                loss = pc.is_in(roles, pa.array([t.encode() for t in trained], pa.large_binary())).to_numpy(zero_copy_only=False)
                base = np.repeat(at[cut[:-1]], np.diff(cut))
                spans = np.concatenate(([0], np.cumsum(loss)))[cut]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cut[:-1])), pa.array(firsts), pa.array(parts), pa.array(np.diff(cut)), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(at[cut].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary()), _lists(pa.array((low - base)[loss]), spans), _lists(pa.array((high - base)[loss]), spans)],
                    ["conv_id", "first", "part", "n_turns", "formatted", "loss_start", "loss_end"],
                )

    rows = turns.select(F.col("conv_id").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.drop("turn").mapInArrow(build, f"conv_id long, {FORMATTED}")


def parse_turns(formatted: bytes) -> tuple[list[bytes], list[bytes]]:
    """Roles and texts of formatted bytes."""
    turns = formatted.split(CLOSE)[:-1]  # the control strings are nowhere else
    pairs = [t[len(OPEN) :].split(BODY) for t in turns]
    out = []
    for k in (0, 1):
        at = np.concatenate(([0], np.cumsum([len(p[k]) for p in pairs]))).astype(np.int64)
        ua, ud = unescape(at, np.frombuffer(b"".join(p[k] for p in pairs), np.uint8))
        raw = ud.tobytes()
        out.append([raw[i:j] for i, j in zip(ua[:-1], ua[1:], strict=True)])
    return out[0], out[1]


def _characters(raw: bytes) -> int:
    return int((np.frombuffer(raw, np.uint8) & 0xC0 != 0x80).sum())


def chat_digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of format_chats' rows, read back from them in their order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, done = None, []

        def flush() -> pa.RecordBatch:
            rows = done.copy()
            done.clear()
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array([c[i] for c in columns], kinds[i]) for i in range(6)], names)

        for batch in batches:
            for conv, first, body, low, high in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6)), strict=True):
                if first:
                    if open_:
                        done.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                roles, texts = parse_turns(body)
                open_[1] += len(roles)
                for role, text in zip(roles, texts, strict=True):
                    open_[2].update(role + b"\n" + text + b"\n")
                masked = [body[i:j] for i, j in zip(low, high, strict=True)]
                plain = unescape(np.concatenate(([0], np.cumsum([len(m) for m in masked]))).astype(np.int64), np.frombuffer(b"".join(masked), np.uint8))[1].tobytes()
                open_[3] += _characters(plain)
                open_[4].update(plain)
                open_[5] += _characters(body)
            if len(done) > 5000:
                yield flush()
        if open_:
            done.append(open_)
        yield flush()

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
