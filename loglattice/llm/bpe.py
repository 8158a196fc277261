"""Byte-level BPE encoding and decoding by merge replay over a corpus of word pieces.

The distinct word pieces of a slice of the corpus are laid out in one symbol
array. An inverted index from merge rank (the id of the token that a pair makes)
to the positions of such pairs, and a heap of the ranks that occur, drive the
replay: the lowest rank is applied at all its positions, and only the two
neighbours of each touched position are looked up anew. Pieces seen before are
kept in a bounded memo, so each distinct piece is replayed about once a worker.

Defined results: a null text counts as empty; an empty text has no ids, and the
digests are those of no bytes; texts of any length are encoded whole; repeated
rows give repeated results; further columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loglattice.llm.common import BoundedMemo, text_slices, worker_state

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = SCHEMA + ", ids array<int>"


def read_ranks(path: str) -> dict[bytes, int]:
    """A ranks file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many word pieces at once by replaying merges in rank order."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        single = [ranks.get(bytes([b]), -1) for b in range(256)]
        if -1 in single:
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.single = np.array(single, np.int64)
        #: The ranks of all pairs of bytes, and those of other pairs as they come up.
        self.bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.pairs: dict[int, int] = {}

    def rank(self, left: int, right: int) -> int:
        """The rank of the token that the pair makes, or -1; keeps it."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        whole = self.ranks.get
        todo = []
        for i, piece in enumerate(pieces):
            if (token := whole(piece)) is not None:
                out[i] = [token]
            elif piece:
                todo.append(i)
        if not todo:
            return out
        raw = np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)
        sizes = np.array([len(pieces[i]) for i in todo])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        first = self.bytes[raw[:-1], raw[1:]]
        first[ends[:-1] - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        index = {int(first[x[0]]): x.tolist() for x in np.split(order, cuts) if len(x)}
        before, after = np.arange(-1, len(raw) - 1), np.arange(1, len(raw) + 1)
        before[starts], after[ends - 1] = -1, -1
        symbols, before, after = self.single[raw].tolist(), before.tolist(), after.tolist()
        pairs, rank = self.pairs, self.rank
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            now = heapq.heappop(heap)
            positions = index.pop(now, None)
            if positions is None:
                continue
            positions.sort()
            token = self.tokens[now]
            for k, at in enumerate(positions):
                here = symbols[at]
                if here < 0 or (right := after[at]) < 0:
                    continue
                there = symbols[right]
                if self.tokens[here] + self.tokens[there] != token:  # a neighbour was merged meanwhile
                    continue
                symbols[at], symbols[right] = now, -1
                after[at] = beyond = after[right]
                least = now
                if beyond >= 0:
                    before[beyond] = at
                    r = pairs.get(key := now << 32 | symbols[beyond])
                    if r is None:
                        r = rank(now, key & 0xFFFFFFFF)
                    if r >= 0:
                        if r in index:
                            index[r].append(at)
                        else:
                            index[r] = [at]
                            heapq.heappush(heap, r)
                        least = min(least, r)
                if (left := before[at]) >= 0:
                    r = pairs.get(symbols[left] << 32 | now)
                    if r is None:
                        r = rank(symbols[left], now)
                    if r >= 0:
                        if r in index:
                            index[r].append(left)
                        else:
                            index[r] = [left]
                            heapq.heappush(heap, r)
                        least = min(least, r)
                if least < now and k + 1 < len(positions):  # a lower rank has appeared: it goes first
                    index[now] = positions[k + 1 :]
                    heapq.heappush(heap, now)
                    break
        for i, at in zip(todo, starts.tolist(), strict=True):
            ids = []
            while at >= 0:
                ids.append(symbols[at])
                at = after[at]
            out[i] = ids
        return out


class Encoder:
    """Whole texts to ids, by units that the pattern cannot match across."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 250_000):
        self.replay = MergeReplay(ranks)
        self.pattern = regex.compile(pattern)
        self.units, self.pieces = BoundedMemo(memo), BoundedMemo(memo)
        self.decimal = {rank: b"%d" % rank for rank in self.replay.tokens}

    def split(self, text: str) -> list[str]:
        """Units of the text; joined they are the text, and no match spans two of them.

        A single blank stays with the word behind it and a single line feed
        stands alone, as the pattern has it. Texts with two blanks in a row,
        or with a character 0, are one unit.
        """
        if _AMBIGUOUS.search(text):
            return [text]
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _compute(self, units: list[str]) -> list[bytes]:
        found = [self.pattern.findall(unit) for unit in units]
        distinct = {piece for pieces in found for piece in pieces}

        def replay(pieces: list[str]) -> list[bytes]:
            ids = self.replay.encode([piece.encode("utf-8", "surrogatepass") for piece in pieces])
            return [np.array(x, np.uint32).tobytes() for x in ids]

        self.pieces.admit(distinct, replay)
        known = self.pieces.young
        return [b"".join([known[piece] for piece in pieces]) for pieces in found]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        split = [self.split(text) if text else [] for text in texts]
        long = [len(units) == 1 and len(units[0]) > 4096 for units in split]
        self.units.admit({u for units, alone in zip(split, long, strict=True) if not alone for u in units}, self._compute)
        get = self.units.young.__getitem__
        return [
            np.frombuffer(self._compute(units)[0] if alone else b"".join(map(get, units)), np.uint32)
            for units, alone in zip(split, long, strict=True)
        ]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids))


#: Two white-space characters in a row, or the mark that units are cut at.
_AMBIGUOUS = re.compile(r"\s\s|\0")


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for a ranks file; made once a worker."""
    return worker_state(("bpe", path, pattern), lambda: Encoder(read_ranks(path), pattern))


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text).

    Returns the number of ids, the SHA-256 of the ids in decimal joined by one
    space, and that of the decoded bytes; with ``with_ids`` the ids as well.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        decimal = own.decimal.__getitem__
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                counts, digests, decoded, all_ids = [], [], [], []
                for ids in own.encode(texts):
                    ids = ids.tolist()
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(b" ".join(map(decimal, ids))).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                columns = {"doc_id": batch.column(0).slice(a, len(texts)), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests), "decoded_sha256": pa.array(decoded)}
                if with_ids:
                    columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, IDS_SCHEMA if with_ids else SCHEMA)
