"""Token-ID output: documents in id order, encoded and written as patched
frame-of-reference file images (:mod:`.pfor`), and the reader of those files.

Documents are range-partitioned by id; a task encodes bounded runs of them and emits
one image per run.  The images go through Spark's writer into one folder (a row holds
one file: its place in the order and its bytes), so any store that Spark reaches will
do.  Positions in the whole stream come from the image headers' sizes alone.

Encoding a text splits it where the tokenizer's own pre-tokenizer always splits, and
looks up every distinct piece once: pieces repeat far more often than texts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, flat_text, rounds, shared_table, span_hashes
from .pfor import Image, encode

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Pieces a worker remembers (some 60 bytes each); beyond it forgets all and starts again.
CACHE = 1_500_000
#: Pieces learned since the last merge into the large table.
RECENT = 100_000
#: Pieces handed to the tokenizer at once, each as a text of its own.
GROUP = 4096
#: Settings of a tokenizer whose pre-tokenizer keeps a run of letters, with one space before
#: it, in one piece.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Letters up to here have been letters in every version of Unicode.
LAST_LETTER = "\u024f"
#: Text of one file image.
IMAGE_BYTES = 4 << 20


def _bytes(*ranges) -> np.ndarray:
    t = np.zeros(256, bool)
    for r in ranges:
        t[list(r)] = True
    return t


#: Kinds of a byte, one bit each.
_LETTER, _POINT, _BLANK, _SPACE, _MAYBE, _LEAD, _HIGH, _FEED = (np.uint8(1 << i) for i in range(8))
_KIND = np.zeros(256, np.uint8)
_KIND[_bytes(range(65, 91), range(97, 123))] |= _LETTER
_KIND[_bytes(b".,;:!?")] |= _POINT
_KIND[_bytes(b" \t\n\r")] |= _BLANK
#: ASCII bytes that some notion of white space includes, and last bytes of white space
#: beyond ASCII (after a lead byte other than C3-DF).
_KIND[_bytes(range(0x09, 0x0E), range(0x1C, 0x21))] |= _SPACE | _MAYBE
_KIND[_bytes(range(0x80, 0x8B), b"\x9f\xa0\xa8\xa9\xaf")] |= _MAYBE
_KIND[_bytes(range(0xC3, 0xE0))] |= _LEAD
_KIND[0x80:] |= _HIGH
_KIND[0x0A] |= _FEED


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_CHARS = _byte_chars()


def piece_starts(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where byte-level pre-tokenization surely splits, text borders included.

    Its pattern never joins a character with white space after it, nor an ASCII letter
    with one of ``.,;:!?`` on either side; and a single line feed between a
    non-blank ASCII character and a letter stands alone.
    """
    n = len(flat)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if n > 1:
        kind = _KIND[flat]
        letter, point, high = (kind & k != 0 for k in (_LETTER, _POINT, _HIGH))
        solid = kind[:-1] & _MAYBE == 0
        solid[1:] |= (kind[:-2] & _LEAD != 0) & high[1:-1]
        solid &= kind[1:] & _BLANK != 0
        solid |= letter[:-1] & point[1:]
        solid |= point[:-1] & letter[1:]
        solid[1:] |= letter[2:] & (kind[1:-1] & _FEED != 0) & (kind[:-2] & (_HIGH | _SPACE) == 0)
        cut[1:n] |= solid
    return np.flatnonzero(cut[:n])


class _Growing:
    """An array that is added to at its end; its room doubles."""

    def __init__(self, *first: int, kind=np.int64):
        self.room, self.n = np.zeros(1 << 16, kind), 0
        self.add(np.array(first, kind))

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.zeros(max(self.n + len(more), 2 * len(self.room)), self.room.dtype)
            room[:self.n] = self.room[:self.n]
            self.room = room
        self.room[self.n:self.n + len(more)] = more
        self.n += len(more)


class Encoder:
    """Token ids of texts; pieces already seen come from a bounded memory."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        told = json.loads(self.tokenizer.to_str())
        split = told.get("pre_tokenizer") or {}
        self.model = None  # what encodes a run of letters by itself
        if told.get("normalizer") is None and all(split.get(k) == v for k, v in BYTE_LEVEL.items()) and not any(
                t["content"].strip().isalpha() for t in told.get("added_tokens") or []):
            self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tables = [none, none]  # hashes in order and the pieces' numbers: most pieces, and the last ones
        self.data, self.at = _Growing(kind=np.uint8), _Growing(0)  # piece k is data[at[k]:at[k + 1]]
        self.ids, self.first = _Growing(kind=np.uint32), _Growing(0)  # and has ids[first[k]:first[k + 1]]

    def _find(self, hashes: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if unknown; the bytes are compared, not only the hashes."""
        out, size = np.full(len(hashes), -1, np.int64), np.diff(offsets)
        starts, data = self.at.room, self.data.room
        for keys, pieces in self.tables:
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            known = pieces[at]
            same = np.flatnonzero((keys[at] == hashes) & (starts[known + 1] - starts[known] == size) & (size > 0))
            if len(same):
                n = size[same]
                border = np.cumsum(n) - n
                step = np.arange(int(n.sum())) - np.repeat(border, n)
                differ = flat[step + np.repeat(offsets[same], n)] != data[step + np.repeat(starts[known[same]], n)]
                same = same[~np.logical_or.reduceat(differ, border)]
                out[same] = known[same]
        return out

    def _remember(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Of pieces with one hash the first is found again."""
        def merged(one, two):
            keys, pieces = (np.concatenate(x) for x in zip(one, two, strict=True))
            order = np.argsort(keys, kind="stable")  # two runs in order: linear
            keys, pieces = keys[order], pieces[order]
            new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
            return keys[new], pieces[new]
        order = np.argsort(hashes, kind="stable")
        recent = merged(self.tables[1], (hashes[order], number[order]))
        if len(recent[0]) > RECENT:
            self.tables = [merged(self.tables[0], recent), (hashes[:0], number[:0])]
        else:
            self.tables[1] = recent

    def _letters(self, text: str) -> list[int] | None:
        """Ids of a run of letters, a space before it or not; None for any other piece."""
        space = text[:1] == " "
        word = text[1:] if space else text
        if not word.isalpha():
            return None
        if not word.isascii():
            if max(word) > LAST_LETTER:
                return None
            word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(_BYTE_CHARS[0x20] + word if space else word)]

    def _learn(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Encode new pieces and remember them; their numbers."""
        flat, offsets = flat_text(pieces)
        texts = pieces.cast(pa.large_string()).to_pylist()
        lists = [self._letters(t) for t in texts] if self.model else [None] * len(texts)
        rest = [i for i, x in enumerate(lists) if x is None]
        for k in range(0, len(rest), GROUP):
            group = rest[k:k + GROUP]
            found = self.tokenizer.encode_batch_fast([texts[i] for i in group], add_special_tokens=False)
            for i, e in zip(group, found, strict=True):
                lists[i] = e.ids
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        number = self.at.n - 1 + np.arange(len(texts))
        self.at.add(self.at.room[self.at.n - 1] + offsets[1:])
        self.first.add(self.first.room[self.first.n - 1] + np.cumsum(sizes))
        self.data.add(flat)
        self.ids.add(ids)
        self._remember(hashes, number)
        return number

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with an end id after every text, ids of each text)."""
        texts = len(offsets) - 1
        starts = piece_starts(flat, offsets)
        starts = starts[starts < len(flat)]
        if self.at.n > CACHE:
            self.forget()
        cuts = np.append(starts, len(flat))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        kinds = pieces.dictionary
        data, border = flat_text(kinds)
        hashes = span_hashes(data, border[:-1], border[1:])
        number = self._find(hashes, data, border)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._learn(kinds.take(pa.array(new)), hashes[new])
        index = number[pieces.indices.to_numpy(zero_copy_only=False)]
        first = self.first.room
        size = first[index + 1] - first[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        border = upto[np.searchsorted(starts, offsets)]  # ids before each text
        total = int(upto[-1])
        shift = np.repeat(first[index] - upto[:-1], size)
        ids = self.ids.room[np.arange(total) + shift]
        out = np.full(total + texts, END_ID, np.uint32)
        owner = np.repeat(np.arange(texts), np.diff(border))
        out[np.arange(total) + owner] = ids
        return out, np.diff(border) + 1


#: Of this worker: the tasks that it runs one after the other share what it remembers.
_ENCODERS: dict[str, Encoder] = {}


def _write(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, _, _ in rounds(batch, "text", IMAGE_BYTES):
                if path not in _ENCODERS:
                    _ENCODERS[path] = Encoder(path)
                parts = [_ENCODERS[path].encode(flat, offsets) for _, flat, offsets in rounds(rows, "text")]
                ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
                doc = rows.column("doc_id")
                data = encode(ids, doc.fill_null(0).to_numpy(zero_copy_only=False),
                              doc.is_null().to_numpy(zero_copy_only=False), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()),
                     pa.array([data], pa.binary())], ["part", "seq", "n_ids", "data"])
                seq += 1
    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending id order into token files.

    ``folder`` is where Spark writes them (the shared checkpoint folder if None).
    Returns the files: part, seq, n_ids, data.  Null ids come first; rows of one id
    are ordered by a hash of their text; a null or empty text is its end id alone.
    """
    bound_batches(docs.sparkSession, 4000, 4 * IMAGE_BYTES)  # several whole images a batch
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), tie)
    files = d.mapInArrow(_write(tokenizer_path), "part int, seq int, n_ids long, data binary")
    if folder is None:
        return shared_table(files, "tokens")
    files.write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.schema(files.schema).parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before = batch.column("before").to_pylist()
        for i in range(batch.num_rows):
            image = Image(batch.column("data")[i].as_py())
            ids = image.ids().astype("<u4")
            end = np.cumsum(image.lengths)
            start = end - image.lengths
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(image.doc_ids, pa.int64(), mask=image.is_null), pa.array(start + before[i]),
                 pa.array(image.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    sizes = files.select("part", "seq", "n_ids")
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per partition of the writer meets in the outer window.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("p0"))
    place = sizes.withColumn("s0", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0))).join(parts, "part")
    place = place.select("part", "seq", (F.col("p0") + F.col("s0")).alias("before"))
    # The places are narrow (one row a file): broadcast them when small, else join.
    small = place.limit(200_001).count() <= 200_000
    d = files.join(F.broadcast(place) if small else place, ["part", "seq"]).select("data", "before")
    return d.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers
    return read_tokens(write_tokens(docs, public_tokenizers.path(TOKENIZER)))
