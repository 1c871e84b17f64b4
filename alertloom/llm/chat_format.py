"""Chat formatting by columnar byte assembly: lengths, offsets and scatter indices in numpy, one preallocated buffer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template of a turn: OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = b"<s>[", b"]\n", b"</s>\n"
#: Bytes that control strings are made of; each is escaped in roles and texts, so that no control string can arise there.
SPECIAL = b"\\<[]"
ESCAPE = SPECIAL[0]
IS_SPECIAL = np.zeros(256, bool)
IS_SPECIAL[list(SPECIAL)] = True
LOSS_ROLE = "assistant"
#: Rows and bytes assembled at a time, about; a conversation is never cut, one larger than that is assembled alone.
ROWS, BYTES = 20_000, 64 << 20
#: Bytes that a formatted conversation, one string, has at most.
MOST_BYTES = 2**31 - 1
SCHEMA = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
TURN = re.compile(r"<s>\[((?:[^\\<\[\]]|\\.)*)\]\n((?:[^\\<\[\]]|\\.)*)</s>\n", re.S)


def flat(a: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = a.cast(pa.large_string())
    a = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).fill_null("")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with ESCAPE before each special byte."""
    special = IS_SPECIAL[data]
    shift = np.concatenate([[0], np.cumsum(special)])
    out = np.full(len(data) + int(shift[-1]), ESCAPE, np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offsets + shift[offsets]


def assemble(roles: pa.Array, texts: pa.Array, firsts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(formatted conversations, start, end): ``firsts`` are each conversation's first row and the end; the bounds of each row's
    text are in code points from its conversation's start."""
    role, role_at = escaped(*flat(roles))
    text, text_at = escaped(*flat(texts))
    n = len(role_at) - 1
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = len(OPEN), len(MIDDLE), len(CLOSE)
    sizes[:, 1], sizes[:, 3] = np.diff(role_at), np.diff(text_at)
    at = np.concatenate([[0], np.cumsum(sizes.ravel())])
    out = np.empty(int(at[-1]), np.uint8)
    starts = at[:-1].reshape(n, 5)
    for k, fixed in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, data, source in ((1, role, role_at), (3, text, text_at)):
        out[np.repeat(starts[:, k] - source[:-1], np.diff(source)) + np.arange(len(data))] = data
    bounds = np.append(at[:-1].reshape(n, 5)[:, 0], at[-1])[firsts]
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    conv = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    base = points[bounds[:-1]][conv] if n else np.zeros(0, np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(firsts) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
    return formatted, points[starts[:, 3]] - base, points[starts[:, 3] + sizes[:, 3]] - base


def _format(table: pa.Table) -> pa.RecordBatch:
    """The conversations of ``table``, with 64-bit offsets."""
    change = _changes(table["conv_id"])
    change[0] = True
    firsts = np.append(np.flatnonzero(change), len(change))
    formatted, start, end = assemble(table["role"], table["text"], firsts)
    loss = pc.equal(table["role"].cast(pa.large_string()).combine_chunks(), LOSS_ROLE).fill_null(False).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(loss)])[firsts]
    spans = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start[loss]), pa.array(end[loss])], ["start", "end"]))
    return pa.RecordBatch.from_arrays([table["conv_id"].combine_chunks().take(pa.array(firsts[:-1])), pa.array(np.diff(firsts)), formatted, spans], ["conv_id", "n_turns", "formatted", "loss"])


def _changes(conv: pa.ChunkedArray) -> np.ndarray:
    """Whether each row's conversation is another than that of the row before."""
    a = conv.combine_chunks()
    plain, null = a.fill_null(0).to_numpy(), a.is_null().to_numpy(zero_copy_only=False)
    out = np.ones(len(plain), bool)
    out[1:] = (plain[1:] != plain[:-1]) | (null[1:] != null[:-1])
    return out


def _sizes(table: pa.Table) -> np.ndarray:
    return sum(pc.fill_null(pc.binary_length(table[c]), 0).to_numpy().astype(np.int64) for c in ("role", "text"))


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose strings need no more than 32-bit offsets, conversations whole; one over MOST_BYTES is an error."""
    sizes = pc.binary_length(batch.column("formatted")).to_numpy()
    if len(sizes) and sizes.max() > MOST_BYTES:
        raise ValueError(f"conversation {batch.column('conv_id')[int(sizes.argmax())]} has {sizes.max()} bytes, more than a string holds")
    lo, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held + n > MOST_BYTES:
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += n
    yield batch.slice(lo)


def _assemble_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formats rows sorted by conversation, once ROWS or BYTES of them are there; the last conversation waits for its end.

    Batches are looked at once each and only kept in a list, so a conversation of many batches costs no more than its rows.
    """
    kept: list[pa.Table] = []
    rows = bytes_ = 0
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(kept)
        for part in _bounded(_format(table)):
            # each part's strings fit 32-bit offsets
            cols = [part.column("formatted").cast(pa.string()) if n == "formatted" else part.column(n) for n in part.schema.names]
            yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        change = _changes(table["conv_id"])
        change[0] = bool(kept) and table["conv_id"][0].as_py() != last
        last = table["conv_id"][-1].as_py()
        size = np.concatenate([[0], np.cumsum(_sizes(table))])
        lo = 0
        for cut in np.flatnonzero(change).tolist():
            if rows + cut - lo >= ROWS or bytes_ + size[cut] - size[lo] >= BYTES:
                kept.append(table.slice(lo, cut - lo))
                yield from flush()
                kept, rows, bytes_, lo = [], 0, 0, cut
        kept.append(table.slice(lo))
        rows, bytes_ = rows + table.num_rows - lo, bytes_ + int(size[-1] - size[lo])
    if kept:
        yield from flush()


def chat_format(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, and loss, the code-point spans of the assistant texts in it.

    Rows go by turn (null first), then role and text, so that ties and repeated rows have one order; repeated rows are turns of
    their own. Null role or text counts as empty; rows of null conv_id are one conversation. Roles other than assistant carry no
    loss. An empty table gives an empty result; other columns are ignored. A conversation of more than MOST_BYTES is an error.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select("conv_id", "role", "text").mapInArrow(_assemble_sorted, SCHEMA)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            said = turns(text)
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
            sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
            rows.append((len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learned), sha(learned), len(text)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted conversations."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
