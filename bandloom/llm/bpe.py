"""Byte-level BPE by monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of text at the leaves of its tree; the leaves of a match are bytes.
LEAF_CHARS = 256
#: Ids at the leaves of decoding.
LEAF_IDS = 1 << 14
#: Bytes of a match whose ids are remembered, as the same halves occur in many matches.
HALF = 16
#: Bytes up to which merges look through all pairs; beyond, the pairs wait in a heap.
PLAIN = 64
#: Entries of a worker's cache, and chunks after which a full one is reviewed.
CACHE = 250_000
REVIEW = 4_000_000
ID_TYPE = "<u4"
#: More than any rank.
NEVER = 1 << 62

UNKNOWN = object()
#: Below it, Unicode's letters are the same in all versions.
STABLE = "\u0250"

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_MARK = "\x1e"  # other white space to Python, so no text without such holds it


def chunks(text: str) -> list[str]:
    """The text cut before every space or line feed that stands between two other characters than white space.

    Whatever surrounds it, a match of the split pattern ends there and another starts, as white space matches only
    before or within a match's first character; so the ids of a text are those of its chunks in turn.
    """
    if not text:
        return []
    single = not any(gap in text for gap in ("  ", " \n", "\n ", "\n\n")) and text[0] not in " \n" and text[-1] not in " \n"
    if not single or _OTHER_SPACE.search(text):
        return _CUT.split(text)
    return text.replace(" ", _MARK + " ").replace("\n", _MARK + "\n").split(_MARK)


class ChunkIds:
    """Ids of chunks, as bytes of ID_TYPE; what isn't known yet is encoded in one call of ``encode_all``.

    The first ``size`` chunks met are kept, which holds the frequent ones without any turnover. If they serve fewer than
    half of REVIEW later chunks, as after a change of language, they go and others take their place.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], size: int = CACHE):
        self.encode_all, self.size, self.known = encode_all, size, {}
        self.asked = self.missed = 0

    def of(self, parts: list[str]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, parts))
        if None not in found:
            self.asked += len(parts)
            return found
        gaps = [k for k, ids in enumerate(found) if ids is None]
        fresh, split = {}, {}
        for k in gaps:
            part = parts[k]
            if (part[-1] in ".," or part[0] == "\n") and len(own := self._pieces(part)) > 1:
                split[part] = own
                fresh.update((p, None) for p in own if p not in known)
            else:
                fresh[part] = None
        new = list(fresh)
        fresh = dict(zip(new, self.encode_all(new)))
        for part, own in split.items():
            fresh[part] = b"".join([fresh.get(p) or known[p] for p in own])
        for k in gaps:
            found[k] = fresh[parts[k]]
        if len(known) < self.size:
            for part, ids in fresh.items():
                if len(part) < 64:
                    known[part] = ids
            return found
        self.asked, self.missed = self.asked + len(parts), self.missed + len(gaps)
        if self.asked >= REVIEW:
            if 2 * self.missed > self.asked:
                known.clear()
            self.asked = self.missed = 0
        return found

    @staticmethod
    def _pieces(chunk: str) -> list[str]:
        """A chunk without its line feed, and without a stop after a letter: these are matches of their own."""
        head = ["\n"] if len(chunk) > 1 and chunk[0] == "\n" and not chunk[1].isspace() else []
        body = chunk[1:] if head else chunk
        if len(body) > 2 and body[-1] in ".," and body[-2].isalpha():
            return [*head, body[:-1], body[-1]]
        return [*head, body]


def _middle(n: int) -> int:
    """The largest power of two below a length, so that repetitions are halved where their tokens end."""
    return 1 << (n - 1).bit_length() - 1


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token bytes, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Codec:
    """Encodes and decodes texts by merge ranks and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes = ranks, {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.bytes}
        self.pattern = regex.compile(pattern)
        self.has_words = r"| ?\p{L}+|" in pattern
        self.chunk_ids = ChunkIds(lambda new: [struct.pack(f"<{len(ids)}I", *ids) for ids in map(self._chunk, new)])
        self.pairs: dict[int, tuple[int, ...] | None] = {}  # tuples of numbers, unlike lists, are nothing that garbage collection walks through
        self.halves: dict[bytes, tuple[int, ...]] = {bytes([b]): (ranks[bytes([b])],) for b in range(256) if bytes([b]) in ranks}
        self.single = dict(self.halves)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, ID_TYPE)
        head, ids, tail = self._tree(text)
        whole = self.chunk_ids.of([head]) if ids is None else [*self.chunk_ids.of([head]), *ids, *self.chunk_ids.of([tail])]
        return np.frombuffer(b"".join(whole), ID_TYPE)

    def _tree(self, text: str) -> tuple[str, list[bytes] | None, str]:
        """Open head, ids of the chunks between, and open tail of a text; without a cut all is head, and there are no ids.

        What lies between two cuts stays whatever stands beside the text, so halves encode it; their open ends wait for
        the join.
        """
        if len(text) <= LEAF_CHARS:
            return self._ends(chunks(text))
        middle = _middle(len(text))
        return self._beside(self._tree(text[:middle]), self._tree(text[middle:]))

    def _ends(self, parts: list[str]) -> tuple[str, list[bytes] | None, str]:
        if len(parts) < 2:
            return parts[0] if parts else "", None, ""
        return parts[0], self.chunk_ids.of(parts[1:-1]), parts[-1]

    def _beside(self, left: tuple, right: tuple) -> tuple[str, list[bytes] | None, str]:
        """Two halves together. The window of the ends at their border is encoded; an end without a cut grows by the other."""
        head, ids, tail = left
        more_head, more_ids, more_tail = right
        window = chunks((head if ids is None else tail) + more_head)
        if ids is None and more_ids is None:
            return self._ends(window)
        if ids is None:
            return window[0], self.chunk_ids.of(window[1:]) + more_ids, more_tail
        if more_ids is None:
            ids += self.chunk_ids.of(window[:-1])
            return head, ids, window[-1]
        ids += self.chunk_ids.of(window)
        ids += more_ids
        return head, ids, more_tail

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a chunk. One of letters, perhaps after a space, is a match by itself; the others are split by the pattern."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if self.has_words and word.isalpha() and max(word) < STABLE:
            return self._match(chunk)
        matches = self.pattern.findall(chunk)
        return self._match(matches[0]) if len(matches) == 1 else tuple(i for m in matches for i in self._match(m))

    def _match(self, match: str) -> tuple[int, ...]:
        token = match.encode()
        return (rank,) if (rank := self.ranks.get(token)) is not None else self.halves.get(token) or self._of_halves(token)

    def _of_halves(self, token: bytes) -> tuple[int, ...]:
        """Ids of bytes by merges alone, as a tree of halves down to single bytes; the halves are remembered."""
        middle = 1 << (len(token) - 1).bit_length() - 1  # as in _middle
        left, right = token[:middle], token[middle:]
        known = self.halves.get
        return self._joined(known(left) or self._half(left), known(right) or self._half(right))

    def _half(self, token: bytes) -> tuple[int, ...]:
        found = self._of_halves(token)
        if len(token) <= HALF:
            if len(self.halves) >= CACHE:
                self.halves = dict(self.single)
            self.halves[token] = found
        return found

    def _joined(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Ids of two halves' bytes together.

        A sequence of ids is the encoding of its bytes if and only if each two neighbours are the encoding of theirs:
        the first merge across a border would come first among the two neighbours alone, too. So a window at the border
        is encoded anew, and grows at an end until that end agrees with the id beside it: ids beyond are proved to stay.
        """
        if (window := self.pairs.get(left[-1] << 32 | right[0], UNKNOWN)) is UNKNOWN:
            window = self._pair(left[-1], right[0])
        if window is None:
            return left + right
        a = b = 1
        while True:
            wide_left = len(left) > a and not self._neighbours(left[-a - 1], window[0])
            wide_right = len(right) > b and not self._neighbours(window[-1], right[b])
            if not (wide_left or wide_right):
                return left[:-a] + window + right[b:]
            a, b = a * (1 + wide_left), b * (1 + wide_right)
            window = self._merged(b"".join(map(self.bytes.__getitem__, left[-a:] + right[:b])))

    def _neighbours(self, a: int, b: int) -> bool:
        if (beside := self.pairs.get(a << 32 | b, UNKNOWN)) is UNKNOWN:
            beside = self._pair(a, b)
        return beside is None

    def _pair(self, a: int, b: int) -> tuple[int, ...] | None:
        """Ids of the bytes of two ids together; none if they are these two, so that they stay beside each other."""
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        found = self._merged(self.bytes[a] + self.bytes[b])
        found = self.pairs[a << 32 | b] = None if found == (a, b) else found
        return found

    def _merged(self, token: bytes) -> tuple[int, ...]:
        """Merges the pair of lowest rank, leftmost first, until there is none; many pairs wait in a heap."""
        ranks, n = self.ranks, len(token)
        if n <= PLAIN:
            parts = [token[i : i + 1] for i in range(n)]
            pairs = [ranks.get(token[i : i + 2], NEVER) for i in range(n - 1)]
            while pairs and (best := min(pairs)) != NEVER:
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            return tuple([ranks[p] for p in parts])
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, start, middle, end = heapq.heappop(heap)
            if ends[start] != middle or middle >= n or ends[middle] != end:
                continue
            ends[start], ends[middle] = end, 0
            if end < n:
                before[end] = start
                if (rank := ranks.get(token[start : ends[end]])) is not None:
                    heapq.heappush(heap, (rank, start, end, ends[end]))
            if (left := before[start]) >= 0 and (rank := ranks.get(token[left:end])) is not None:
                heapq.heappush(heap, (rank, left, start, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[token[at : ends[at]]])
            at = ends[at]
        return tuple(out)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_codecs: dict[tuple, Codec] = {}


def _codec(content: bytes, pattern: str) -> Codec:
    key = (hash(content), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(content), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` for every row's whole text.

    The rank file is read on the driver and broadcast; a vocabulary's size is fixed. A null or empty text has no ids:
    its digests are those of nothing. Rows that repeat are encoded each; other columns are ignored.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            columns = [[], [], [], []]
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                numbers = ids.tolist()
                columns[0].append(len(numbers))
                columns[1].append(hashlib.sha256(" ".join(map(codec.digits.__getitem__, numbers)).encode()).hexdigest())
                columns[2].append(hashlib.sha256(codec.decode(numbers)).hexdigest())
                columns[3].append(numbers if with_ids else None)
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            if with_ids:
                arrays.append(pa.array(columns[3], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(of, schema)
