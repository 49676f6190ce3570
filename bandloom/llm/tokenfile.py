"""Token ids in a binary file format: Simple-8b words in blocks, found by per-block offsets.

A file is a row of blocks, each closed by SEPARATOR. A block holds, in little-endian order, this header of 8-byte words:
magic, number of the file, number of the block in it, documents, ids, words; then doc_ids (documents words), a bit map of
null doc_ids (a byte each, padded to words), ids per document (documents words), the first word of each run of RUN ids
(run offsets), and the words. A word's low 4 bits select how many ids its other 60 bits hold, and how wide each is;
selector 0 is the escape: the next word holds one id of up to 64 bits. A word never crosses the end of a run, so a range
of ids is decoded from its own runs' offset on, all words of these at once with numpy.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bandloom.llm.shared import materialize, new_path

MAGIC = int.from_bytes(b"S8BTOKEN", "little")
SEPARATOR = "\x00\x00S8B\x00\x00\x01"
HEADER = 6
#: Width of the ids by selector; 60 // width of them are in a word. Selector 0 is the escape.
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 16, 20, 30, 60)
COUNTS = tuple(60 // w if w else 1 for w in WIDTHS)
#: Ids between two offsets; ids of a block from which it is written; runs that are decoded at a time.
RUN = 4096
BLOCK = 1 << 18
PIECE = 64
END = 0
#: Bytes of text whose chunks are looked up together, if a document doesn't hold more.
TOGETHER = 4 << 20
#: Chunks that are encoded in one text.
JOINT = 1024
#: Chunks that a worker knows, the bytes of the longest, and chunks after which a full store is reviewed.
KNOWN = 500_000
LONGEST = 64
REVIEW = 2_000_000
#: Bytes of text aimed at in one file.
FILE_BYTES = 64 << 20
_BY_WIDTH = np.array([next(s for s in range(1, 16) if WIDTHS[s] >= w) if w <= 60 else 0 for w in range(65)])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned 64-bit ids, and the first word of each run. Each word takes as many ids as fit."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least = _BY_WIDTH[_bit_lengths(ids)]
    escape = least == 0
    widest = np.where(escape, 16, least).astype(np.int8)
    best = np.where(escape, 0, 15).astype(np.int8)
    at = np.arange(n)
    room = np.minimum(np.minimum(RUN - at % RUN, n - at), COUNTS[1]).astype(np.int8)
    done = 1
    for s in range(15, int(widest.min()) - 1, -1):
        count = COUNTS[s]
        while done < count:  # widest[i]: the widest of the ids i .. i + done - 1
            step = min(done, count - done)
            if step < n:
                widest[: n - step] = np.maximum(widest[: n - step], widest[step:])
            done += step
        np.copyto(best, s, where=(widest <= s) & (room >= count))
    counts = np.array(COUNTS)[best]
    starts, at, jump = [], 0, counts.tolist()
    while at < n:
        starts.append(at)
        at += jump[at]
    first = np.array(starts)
    kind = best[first]
    extra = np.cumsum(kind == 0)
    place = np.arange(len(first)) + extra - (kind == 0)
    words = np.zeros(len(first) + int(extra[-1]), np.uint64)
    words[place] = kind.astype(np.uint64)
    for s in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == s)
        if s == 0:
            words[place[mine] + 1] = ids[first[mine]]
            continue
        for k in range(COUNTS[s]):
            words[place[mine]] |= ids[first[mine] + k] << np.uint64(4 + k * WIDTHS[s])
    return words, place[np.searchsorted(first, np.arange(0, n, RUN))]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of words, which start at a run's offset."""
    kind = (words & np.uint64(15)).astype(np.int64)
    if (kind == 0).any():
        plain = np.ones(len(words), bool)
        for at in np.flatnonzero(kind == 0).tolist():
            if plain[at]:
                plain[at + 1 : at + 2] = False
    else:
        plain = None
    heads = np.arange(len(words)) if plain is None else np.flatnonzero(plain)
    kind = kind[heads]
    counts = np.array(COUNTS)[kind]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(kind).tolist():
        mine = kind == s
        if s == 0:
            out[starts[mine]] = words[heads[mine] + 1]
            continue
        part, mask = words[heads[mine]], np.uint64((1 << WIDTHS[s]) - 1)
        for k in range(COUNTS[s]):
            out[starts[mine] + k] = part >> np.uint64(4 + k * WIDTHS[s]) & mask
    return out


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    low = (ids & np.uint64((1 << 32) - 1)).astype(np.float64)
    out = np.frexp(low)[1]  # exact, as a double holds 32 bits
    high = ids >> np.uint64(32)
    if high.any():
        out = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], out)
    return out


def block(file: int, number: int, doc_ids: list, counts: np.ndarray | list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    null = np.pad(null, (0, -len(null) % 8))
    head = struct.pack("<6Q", MAGIC, file, number, len(doc_ids), len(ids), len(words))
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), null, np.array(counts, "<i8"), offsets.astype("<i8"), words.astype("<u8")]
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """One block of a file; ids are decoded when asked for."""

    def __init__(self, content: bytes, at: int):
        magic, self.file, self.number, docs, self.size, words = struct.unpack_from("<6Q", content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += 8 * HEADER
        doc_ids = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, np.uint8, docs, at := at + 8 * docs)
        self.doc_ids = [None if z else d for d, z in zip(doc_ids.tolist(), null.tolist())]
        self.counts = np.frombuffer(content, "<i8", docs, at := at + docs + -docs % 8)
        runs = -(-self.size // RUN)
        self.offsets = np.frombuffer(content, "<i8", runs, at := at + 8 * docs)
        self.words = np.frombuffer(content, "<u8", words, at := at + 8 * runs)
        self.end = at + 8 * words

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at start .. stop - 1, from the words of the runs that hold them."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first, last = start // RUN, -(-stop // RUN)
        end = int(self.offsets[last]) if last < len(self.offsets) else len(self.words)
        found = unpack(self.words[int(self.offsets[first]) : end])
        if len(found) != min(last * RUN, self.size) - first * RUN:
            raise ValueError("a run holds another number of ids than its offsets say")
        return found[start - first * RUN : stop - first * RUN]

    def crcs(self) -> list[int]:
        """CRC-32 of each document's ids as little-endian unsigned 32-bit integers; PIECE runs are decoded at a time."""
        out, crc, doc = [], 0, 0
        ends = np.cumsum(self.counts).tolist()
        for at in range(0, self.size, PIECE * RUN):
            stop = min(at + PIECE * RUN, self.size)
            raw, done = memoryview(self.ids(at, stop).astype("<u4").tobytes()), at
            while doc < len(ends) and ends[doc] <= stop:
                out.append(zlib.crc32(raw[4 * (done - at) : 4 * (ends[doc] - at)], crc))
                done, crc, doc = ends[doc], 0, doc + 1
            crc = zlib.crc32(raw[4 * (done - at) :], crc)
        return out + [0] * (len(ends) - len(out))


def blocks(content: bytes) -> Iterator[Block]:
    """The blocks of a file."""
    at = 0
    while at < len(content):
        block = Block(content, at)
        yield block
        at = block.end + len(SEPARATOR)


class _Library:
    """Ids of many chunks by the tokenizers library, as it is called without special tokens.

    Chunks that start with a space can stand in one text without an effect on each other, which costs less than a call
    for each; the lengths of the tokens tell which ids are whose.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.library = Tokenizer.from_str(definition)
        form = json.loads(definition)
        split = form.get("pre_tokenizer") or {}
        #: Whether texts may be cut where ``cuts`` says; else every text is one chunk.
        self.separable = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not form.get("normalizer")
        self.added = [t["content"] for t in form.get("added_tokens", [])]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.lengths[number] = len(token)  # a character for each byte

    def __call__(self, new: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The chunks in another order, all their ids, and how many ids each has."""
        joint, single = [], []
        for c in [c.decode() for c in new]:
            (joint if self.separable and len(c) > 1 and c[0] == " " and not c[1].isspace() and not c[-1].isspace() else single).append(c)
        if any(a in c for c in joint for a in self.added):
            single += [c for c in joint if any(a in c for a in self.added)]
            joint = [c for c in joint if not any(a in c for a in self.added)]
        ids, counts = [], []
        if joint:
            texts = ["".join(joint[at : at + JOINT]) for at in range(0, len(joint), JOINT)]
            ids = [np.array(found.ids, np.uint32) for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            ends = np.cumsum(pc.binary_length(pa.array(joint, pa.string())).to_numpy().astype(np.int64))
            places = np.searchsorted(np.cumsum(self.lengths[np.concatenate(ids)]), ends) + 1
            counts = [np.diff(places, prepend=0)]
        if single:
            own = [np.array(found.ids, np.uint32) for found in self.library.encode_batch_fast(single, add_special_tokens=False)]
            ids, counts = ids + own, [*counts, np.fromiter(map(len, own), np.int64, len(own))]
        return [c.encode() for c in joint + single], np.concatenate(ids), np.concatenate(counts)


_SPACES, _ALNUM, _MARK, _LEAD = np.zeros((4, 256), bool)
_SPACES[[*range(9, 14), *range(28, 33)]] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: First bytes of characters that may be white space beyond ASCII.
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_STARTS = _MARK.copy()
_STARTS[[10, 32]] = True


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 where a match of the split pattern ends and another starts, whatever surrounds them.

    These are before a space or line feed, and after a line feed, that stands between two characters that surely aren't
    white space, which matches only before or within a match's first character; and before an ASCII mark after an ASCII
    letter or digit. As the pattern doesn't look back, the ids of a text are those of its chunks in turn.
    """
    at = np.flatnonzero(_STARTS[data])
    at = at[(at > 0) & (at < len(data) - 1)]
    here, before, after = data[at], data[at - 1], data[at + 1]
    gap = here <= 32
    sure = gap & ~(_SPACES[before] | _SPACES[after] | _LEAD[after])
    wide = np.flatnonzero(sure & (before >= 0x80))
    sure[wide[(data[np.maximum(at[wide] - 2, 0)] == 0xC2) | (_LEAD[data[np.maximum(at[wide] - 3, 0)]] & (at[wide] >= 3))]] = False
    return np.sort(np.concatenate((at[sure | (~gap & _ALNUM[before])], at[sure & (here == 10)] + 1)), kind="stable")


class TextIds:
    """Ids of texts. Chunks that are met again aren't encoded again.

    The first KNOWN chunks met are kept, which holds the frequent ones without any turnover. If they serve fewer than
    half of the different chunks among REVIEW later ones, as after a change of language, they go.
    """

    def __init__(self, library: _Library, size: int = KNOWN):
        self.library, self.size = library, size
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.asked = self.missed = 0

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, END after each, and their number by text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        starts, ends = ends[:-1], ends[1:]
        # an empty chunk, between a text's end and the next one's start, stands for END
        places = np.concatenate((starts, self._cuts(texts, data, starts, ends), ends[ends > starts], ends[-1:])).astype(np.int32)
        places.sort(kind="stable")
        parts = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        which = parts.indices.to_numpy()
        bounds = np.frombuffer(parts.dictionary.buffers()[1], np.int32)[: len(parts.dictionary) + 1].tolist()
        raw = (parts.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        words = [raw[i:j] for i, j in itertools.pairwise(bounds)]
        flat, first, count = self._words(words)
        count, first = count[which], first[which]
        total = np.cumsum(count)
        ids = flat[np.arange(int(total[-1])) + np.repeat(first - total + count, count)]
        closing = total[which == words.index(b"")]
        return ids, np.diff(closing, prepend=0)

    def _cuts(self, texts: pa.Array, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not self.library.separable:
            return np.zeros(0, np.int64)
        at = cuts(data)
        sure = np.ones(len(at), bool)
        for edge in (starts, ends - 1, ends):  # what is beyond belongs to another text
            near = np.searchsorted(at, edge)
            near = near[(near < len(at)) & (at[np.minimum(near, len(at) - 1)] == edge)] if len(at) else near[:0]
            sure[near] = False
        for token in self.library.added:  # a text that holds one stays whole
            holds = pc.match_substring(texts, token)
            if pc.any(holds).as_py():
                sure &= ~holds.to_numpy(zero_copy_only=False)[np.searchsorted(starts, at, "right") - 1]
        return at[sure]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word where its own start and how many they are."""
        rows = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(rows < 0)
        new = [words[k] for k in gaps.tolist()]
        short = [w for w in new if w and len(w) < LONGEST]
        kept = len(self.starts) - 1
        ids, starts = self.ids, self.starts
        place = {b"": kept}
        ids, starts = np.append(ids, np.uint32(END)), np.append(starts, len(ids) + 1)
        for part in (short, [w for w in new if len(w) >= LONGEST]):
            if part:
                named, own, counts = self.library(part)
                place.update(zip(named, range(len(starts) - 1, len(starts) - 1 + len(named))))
                ids, starts = np.concatenate((ids, own)), np.concatenate((starts, starts[-1] + np.cumsum(counts)))
                if part is short and len(self.known) < self.size:
                    self.known.update(itertools.islice(place.items(), 1, None))
                    self.ids, self.starts = ids, starts
        rows[gaps] = np.fromiter(map(place.__getitem__, new), np.int64, len(new))
        first, counts = starts[rows], starts[rows + 1] - starts[rows]
        self.asked, self.missed = self.asked + len(words), self.missed + len(new)
        if self.asked >= REVIEW:
            if len(self.known) >= self.size and 2 * self.missed > self.asked:
                self._clear()
            self.asked = self.missed = 0
        return ids, first, counts


_encoders: dict[int, TextIds] = {}


def _encoder(definition: str) -> TextIds:
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextIds(_Library(definition))
    return _encoders[key]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with TOGETHER bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, "right")))
        yield at, end
        at = end


def write(docs: DataFrame, tokenizer_path: str, path: str, files: int | None = None) -> None:
    """Write the ids of all whole texts, each document closed by END, as files in ascending order of doc_id.

    Null doc_ids come first; rows that share a doc_id are ordered by a hash of the text. A null text has no ids but END.
    Ids are those that the library gives without special tokens; strings of added tokens in a text are these tokens. Rows
    are dealt to files by ranges of doc_id, hash and row, so each file is one task's, of bounded size even if all rows
    share one doc_id, and file numbers follow the order. Texts go to the tokenizer in chunks whose ids don't depend on
    what surrounds them (``cuts``), so that a chunk met again isn't encoded again; a text without such cuts is one chunk.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(-(-size // FILE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = _encoder(definition.value), 0
        file = TaskContext.get().partitionId()
        doc_ids, counts, held, size = [], [], [], 0
        for batch in batches:
            for at, end in _slices(batch.column(1)):
                found, own = encoder.of(batch.column(1).slice(at, end - at))
                own_ids, before, first = batch.column(0).slice(at, end - at).to_pylist(), 0, 0
                for last in _block_ends(own, BLOCK - size):
                    upto = before + int(own[first:last].sum())
                    doc_ids += own_ids[first:last]
                    counts.append(own[first:last])
                    held.append(found[before:upto])
                    size, before, first = size + upto - before, upto, last
                    if size >= BLOCK:
                        yield closed(file, number, doc_ids, counts, held)
                        doc_ids, counts, held, size, number = [], [], [], 0, number + 1
        if doc_ids:
            yield closed(file, number, doc_ids, counts, held)

    def closed(file: int, number: int, doc_ids: list, counts: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(held).astype(np.uint64)
        return pa.RecordBatch.from_arrays([pa.array([block(file, number, doc_ids, np.concatenate(counts), ids)])], ["block"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("doc_id", "text", order[1].alias("hash"), order[2].alias("row"))
    order = [order[0], "hash", "row"]
    ordered = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(of, "block binary").selectExpr("cast(block AS string) AS value").write.option("lineSep", SEPARATOR).text(path)


def _block_ends(counts: np.ndarray, room: int) -> list[int]:
    """Documents after which a block is full, and the last; ``room`` is what the first one has left."""
    total, ends = np.cumsum(counts), []
    while not ends or ends[-1] < len(counts):
        at = ends[-1] if ends else 0
        ends.append(min(len(counts), int(np.searchsorted(total, (int(total[at - 1]) if at else 0) + room)) + 1))
        room = BLOCK
    return ends


def read(spark: SparkSession, path: str) -> DataFrame:
    """``file, doc_id, local, n_tokens, ids_crc32`` per document of the files at ``path``, decoded from them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                before = 0
                for b in blocks(content.as_buffer().to_pybytes()):
                    n, ends = len(b.doc_ids), np.cumsum(b.counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.file] * n), pa.array(b.doc_ids, pa.int64()), pa.array(before + ends - b.counts), pa.array(b.counts), pa.array(b.crcs(), pa.int64())],
                        ["file", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    before += b.size

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(of, "file long, doc_id long, local long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, files: int | None = None) -> DataFrame:
    """Write all texts' ids and read them back: ``doc_id, start, n_tokens, ids_crc32`` per row.

    ``start`` counts the ids of all documents before; only one number for each file is summed across files. An empty
    table gives no files and an empty result.
    """
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    write(docs, tokenizer_path, path, files)
    found = materialize(read(spark, path), "token-rows")
    sums = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    starts = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return found.join(starts, "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
