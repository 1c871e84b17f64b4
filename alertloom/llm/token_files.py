"""Token ids as flat unsigned integer files with 64-bit document offsets, written by Spark tasks and read through memory maps.

A folder holds, for each shard of consecutive documents, ``part-N.bin`` (the ids, unsigned, little-endian, 16 bits wide where the
vocabulary fits and 32 otherwise), ``part-N.idx`` (64-bit ends of its documents, in ids from the shard's start) and ``part-N.doc``
(their 64-bit doc_ids), and one table ``manifest`` with a row for each shard: documents, documents of null doc_id (they come first),
ids, and the two bases, which are prefix sums over the shards before it.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.llm.common import shared_dir, stash, unstash

#: Id that ends each document.
END = 2
#: Bytes of text that are cut at a time (a longer text is taken alone), distinct pieces whose ids a worker remembers, and pieces that the
#: tokenizer takes at a time.
CHUNK = 2 << 20
REMEMBERED = 1 << 19
AT_ONCE = 1 << 13
#: Documents in a batch of what is read back.
READ_ROWS = 8192
SHARD = "shard int, n_docs long, n_nulls long, n_ids long, width int"

# Byte classes of the cut. Only words of the first four classes are cut; others are encoded as they are.
SPACE, LETTER, DIGIT, SIGN, WIDE, ODD = range(6)
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = SIGN
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[0xC3] = WIDE
CLASS[39] = ODD
#: Small letters of the words that are cut: ASCII, and the second bytes of U+00C0 to U+00DE.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
SMALL[0x80:0x9F] += 32
#: What a tokenizer must say of itself so that its texts may be cut at white space and between letters, digits and signs.
FIXED_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
FIXED_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def cuttable(spec: dict) -> bool:
    """Whether the tokenizer of this JSON gives a text the ids of its pieces, one after the other."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = steps[0]
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and t["content"].startswith("<|") and t["content"].isascii() and not set(t["content"]) & set(" \t\n") for t in spec.get("added_tokens") or [])
    return (
        added
        and spec.get("normalizer") == FIXED_NORMALIZER
        and spec.get("post_processor") is None
        and split.get("pattern") == {"Regex": FIXED_PATTERN}
        and split.get("invert") is True
        and split.get("behavior") == "Removed"
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[1].get("use_regex") is False
        and steps[1].get("add_prefix_space") is False
    )


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts and ends, in turn; bytes) of the pieces of texts joined in ``data``: words, cut between letters, digits and signs, in
    small letters, as the tokenizer would have them.

    A word that holds an apostrophe, ``<|``, or any character but ASCII and the letters from U+00C0 to U+00FF isn't cut: contractions,
    special tokens, marks that combine and other classes of characters may reach over a cut there.
    """
    kind = CLASS[data]
    wide = np.flatnonzero(kind == WIDE)
    wide = wide[wide + 1 < len(data)]
    second = data[wide + 1]
    letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    kind[wide[letter]] = kind[wide[letter] + 1] = LETTER
    kind[kind == WIDE] = ODD
    mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) else np.zeros(0, np.int64)
    kind[mark] = ODD
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = kind != SPACE
    word = edge[:-1].copy()
    word[1:] |= solid[1:] != solid[:-1]
    starts = np.flatnonzero(word)
    odd = np.zeros(len(starts), bool)
    if len(starts):
        odd = np.logical_or.reduceat(kind == ODD, starts)
    cut = word
    cut[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    inside = np.repeat(odd, np.diff(np.append(starts, len(data))))
    cut &= ~inside
    cut[starts] = True
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], len(data))[: len(begins)]
    full = solid[begins]
    return np.column_stack([begins[full], ends[full]]).ravel(), np.where(inside, data, SMALL[data])


class Encoder:
    """Ids of many texts at once, equal to those of encoding each whole text by itself, with the end id after each."""

    def __init__(self, spec: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.cuts = Tokenizer.from_str(spec), end, cuttable(json.loads(spec))
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.lengths = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Places of these pieces among the remembered ones; the tokenizer sees those that are new."""
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            ids, lengths = [self.ids], [self.lengths]
            for lo in range(0, len(new), AT_ONCE):
                found = [x.ids for x in self.tokenizer.encode_batch_fast([p.decode() for p in new[lo : lo + AT_ONCE]], add_special_tokens=False)]
                ids.append(np.fromiter((i for x in found for i in x), self.dtype))
                lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        return np.fromiter((self.known[p] for p in distinct), np.int64, len(distinct))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each) of a large_string array without nulls."""
        if not self.cuts:
            found = [[*x.ids, self.end] for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, self.dtype), *[np.asarray(x, self.dtype) for x in found]]), np.cumsum([len(x) for x in found], dtype=np.int64)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        bounds, data = pieces(data, offsets)
        if len(bounds):
            # Pieces and the gaps between them as one binary array over the same bytes; the gaps are left out again by stride.
            laid = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
            which = laid.indices.to_numpy()[::2]
            used = np.flatnonzero(np.bincount(which, minlength=len(laid.dictionary)))
            place = np.zeros(len(laid.dictionary), np.int64)
            place[used] = self.numbers(laid.dictionary.take(pa.array(used)).to_pylist())
            place = place[which]
        else:
            place = np.zeros(0, np.int64)
        length = self.lengths[place]
        ends = np.append(0, np.cumsum(length))
        first = np.cumsum(self.lengths) - self.lengths
        flat = self.ids[np.repeat(first[place] - ends[:-1], length) + np.arange(ends[-1])]
        # Ids before the end of each text, then one end id for each.
        stop = ends[np.searchsorted(bounds[::2], offsets[1:])]
        return np.insert(flat, stop, self.end).astype(self.dtype), stop + np.arange(1, len(stop) + 1)


#: The encoder of a Python worker, kept over its tasks with the ids that it remembers.
_kept: dict[tuple, Encoder] = {}


def _encoder(spec: str, end: int) -> Encoder:
    if (spec, end) not in _kept:
        _kept.clear()
        _kept[spec, end] = Encoder(spec, end)
    return _kept[spec, end]


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about CHUNK bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
        yield texts.slice(lo, hi - lo)
        lo = hi


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _writer(spec, folder: str, end: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = None, TaskContext.get().partitionId()
        docs = nulls = total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                # An attempt writes files of its own; the whole ones then take the shard's names, so a repeated task does no harm.
                encoder, (store, top), mine = _encoder(spec.value, end), _store(folder), uuid.uuid4().hex
                store.create_dir(top, recursive=True)
                names = [f"{top}/part-{shard:06d}.{x}" for x in ("bin", "idx", "doc")]
                out = [store.open_output_stream(f"{n}.{mine}") for n in names]
            ids = batch.column("doc_id")
            docs, nulls = docs + len(ids), nulls + ids.null_count
            out[2].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for texts in _slices(batch.column("text").cast(pa.large_string())):
                flat, ends = encoder.encode(texts)
                out[0].write(flat.tobytes())
                out[1].write((ends + total).astype("<u8").tobytes())
                total += len(flat)
        if encoder is None:
            return
        for stream, name in zip(out, names, strict=True):
            stream.close()
            if not isinstance(store, fs.LocalFileSystem) and store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            store.move(f"{name}.{mine}", name)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "n_docs": [docs], "n_nulls": [nulls], "n_ids": [total], "width": pa.array([encoder.dtype.itemsize], pa.int32())})

    return write


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = END) -> str:
    """Encode every whole text of ``docs`` (doc_id, text) with the tokenizer of the JSON file ``tokenizer``, append the id ``end`` to
    each document and write the ids in ascending order of doc_id; returns the folder (by default a new one in the shared folder).

    A null or empty text has the end id alone. Documents of null doc_id come first; rows that share a doc_id follow one another by a
    hash of their text, then by text; equal rows are written as often as they come. An empty table gives a manifest without rows.
    Other columns aren't read. Texts move once, in the shuffle by ranges of doc_id; a range of one doc_id is split by the text's hash.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    spec = spark.sparkContext.broadcast(open(tokenizer, encoding="utf-8").read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mix", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mix")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    shards = stash(dealt.select("doc_id", "text").mapInArrow(_writer(spec, folder, end), SHARD))
    # One row for each shard, so its window over all of them is small.
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(b) for c, b in (("n_docs", "doc_base"), ("n_ids", "id_base"))])
    based.coalesce(1).write.parquet(f"{folder}/manifest")
    unstash(shards)
    return folder


class Shard:
    """The three files of one shard: mapped where they lie on a mounted disk, else read by ranges."""

    def __init__(self, folder: str, shard: int, width: int):
        self.store, top = _store(folder)
        self.names = {x: f"{top}/part-{shard:06d}.{x}" for x in ("bin", "idx", "doc")}
        self.types = {"bin": np.dtype(f"<u{width}"), "idx": np.dtype("<u8"), "doc": np.dtype("<i8")}
        self.maps: dict[str, np.ndarray] = {}

    def read(self, what: str, lo: int, hi: int) -> np.ndarray:
        kind = self.types[what]
        if hi <= lo:
            return np.zeros(0, kind)
        if isinstance(self.store, fs.LocalFileSystem):
            if what not in self.maps:
                self.maps[what] = np.memmap(self.names[what], kind, "r")
            return self.maps[what][lo:hi]
        with self.store.open_input_file(self.names[what]) as f:
            return np.frombuffer(f.read_at((hi - lo) * kind.itemsize, lo * kind.itemsize), kind)


def _reader(folder: str, shards: list[tuple]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, n, nulls, _, width, _, base = shards[k]
                files = Shard(folder, shard, width)
                for lo in range(0, n, READ_ROWS):
                    hi = min(n, lo + READ_ROWS)
                    ends = files.read("idx", lo, hi).astype(np.int64)
                    starts = np.append(files.read("idx", lo - 1, lo).astype(np.int64) if lo else 0, ends[:-1])
                    crc = [zlib.crc32(files.read("bin", a, b).astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    ids = pa.array(files.read("doc", lo, hi).astype(np.int64), mask=np.arange(lo, hi) < nulls)
                    yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": starts + base, "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})

    return read


def manifest(spark: SparkSession, folder: str) -> list[tuple]:
    """The shards in order: (shard, n_docs, n_nulls, n_ids, width, doc_base, id_base), a few numbers for each written partition."""
    return [tuple(r) for r in spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()]


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32 (of the ids as 32-bit integers) of
    every document, from the files: one task for each shard."""
    shards = manifest(spark, folder)
    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(_reader(folder, shards), "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` to ``stop`` of the whole stream, as a training job reads its windows; shards are found by their bases."""
    out = [np.zeros(0, np.uint32)]
    for shard, _, _, n, width, _, base in manifest(spark, folder):
        lo, hi = max(start - base, 0), min(stop - base, n)
        if lo < hi:
            out.append(Shard(folder, shard, width).read("bin", lo, hi).astype(np.uint32))
    return np.concatenate(out)
