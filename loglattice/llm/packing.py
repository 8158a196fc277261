"""Best-fit packing of tokenised documents by bin completion.

Tokenising is one narrow pass: texts are cut at blanks and line feeds, which the
tokenizer's pattern never crosses, and each distinct chunk is encoded once a
worker (bounded memo). Only documents beyond the capacity are cut. The pieces,
without their ids, are checkpointed and dealt out evenly into as many parts as
their number asks for, whatever the session's partitions, and every task packs
its part alone, so no task depends on the number of documents.

Within a part the best-fit decreasing solution is the first incumbent, and the
waste bound (Martello and Toth's L2: pieces over half a sequence, and those that
cannot join them, each against the space that is left) is the number that no
packing can go below. Where the two meet the incumbent is proven. Else bin
completion searches depth first: the largest piece left opens a sequence; the
undominated fillings of the rest follow by increasing waste; a branch ends where
its sequences and the waste bound of what is left reach the incumbent, and each
improvement becomes the incumbent. A filling is dominated if another one can
take its place in every packing: if its pieces can be dealt onto the other's
pieces so that none is exceeded. By Korf's theorem it is enough that no set of
its pieces can be replaced by one larger piece that is left and fits.

A search that comes to its end has proven its incumbent. ``STEPS``, the work of
enumerating and branching, bounds one part's search; where it is spent the
incumbent is returned and ``proven`` is false. No piece is ever left out.

Defined results: a null or empty text is the single closing id; repeated rows
are packed as often as they occur; an empty table gives no rows; a null doc_id
is packed like any other; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglattice.llm.common import BoundedMemo, array_slices, durable, worker_state

CAPACITY = 2048
#: Pieces that are packed together; bounds a task's memory.
CHUNK_PIECES = 1 << 14
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 21
#: Steps of a part's search: pieces tried while fillings are enumerated, and ten for each node.
STEPS = 400_000

#: Latin letters that have one lower case each, and marks that may stand behind a word of them.
LATIN, MARKS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]", ".,;:!?"
#: What a token that closes a word ends with, how many words are encoded together, and words of the memo.
WORD_END, TOGETHER, MEMO = "</w>", 256, 250_000

PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
IDS_SCHEMA = PIECES_SCHEMA + ", ids array<int>"


class ChunkTokenizer:
    """A tokenizer whose pattern never crosses white space, with a memo of words.

    Latin words are told from the mark behind them and put into lower case, as
    the tokenizer itself does, so that the memo has each once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = BoundedMemo(MEMO)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.marks = [b"", *self._compute(list(MARKS))]

    def _compute(self, words: list[str]) -> list[bytes]:
        """The ids of each word; plain ones are encoded together, and parted again where a token closes a word."""
        out: list[bytes] = [b""] * len(words)
        plain = pc.match_substring_regex(pa.array(words, pa.string()), f"^{LATIN}+$").to_numpy(zero_copy_only=False)
        together, rest = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        lines = [together[a : a + TOGETHER].tolist() for a in range(0, len(together), TOGETHER)]
        found = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in line]) for line in lines], add_special_tokens=False)
        for line, encoded in zip(lines, found, strict=True):
            ids = np.array(encoded.ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            if len(ends) != len(line):
                rest += line
                continue
            raw, begin = ids.tobytes(), 0
            for i, end in zip(line, ends, strict=True):
                out[i] = raw[begin:end]
                begin = end
        for i, encoded in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", encoded.ids).tobytes()
        return out

    def _parts(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The word of each chunk, and the number of the mark behind it, 0 for none."""
        marked = pc.match_substring_regex(chunks, f"^{LATIN}+[{MARKS}]$")
        words = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks)
        words = pc.if_else(pc.match_substring_regex(words, f"^{LATIN}+$"), pc.utf8_lower(words), words)
        marks = pc.if_else(marked, pc.utf8_slice_codeunits(chunks, -1), "")
        return words, 1 + pc.fill_null(pc.index_in(marks, pa.array(list(MARKS))), -1).to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers.

        Arrow cuts the texts and numbers their distinct chunks and words, the
        memo has the ids of these, and NumPy puts them together.
        """
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        chunks = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        words, mark = self._parts(coded.dictionary)
        words = words.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        self.memo.admit(distinct, self._compute)
        known = [*map(self.memo.young.__getitem__, distinct), *self.marks]
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        flat, place = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        pairs = np.stack([words.indices.to_numpy(), len(distinct) + mark], axis=1)[coded.indices.to_numpy()].ravel()
        length = size[pairs]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(place[pairs] - (ends - length), length)
        raw = flat[at].tobytes()
        last = 2 * np.cumsum(pc.list_value_length(chunks).to_numpy())
        bounds = [0, *(4 * ends[last - 1]).tolist()]
        return [raw[begin:end] for begin, end in zip(bounds, bounds[1:], strict=False)]


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer of a file; made once a worker."""
    return worker_state(("tokenizer", path), lambda: ChunkTokenizer(path))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, closing_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Each document's ids and the closing id, cut after every ``capacity`` ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        closing = np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, texts in array_slices(batch.column(1), SLICE_BYTES):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc_id, ids in zip(doc_ids[a : a + len(texts)], own.encode(texts), strict=True):
                    ids += closing
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out["doc_id"].append(doc_id)
                        out["piece"].append(piece)
                        out["start"].append(at // 4)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            out["ids"].append(np.frombuffer(part, "<u4").tolist())
                arrays = {k: pa.array(out[k], pa.int32() if k == "piece" else pa.int64()) for k in out if k != "ids"}
                if with_ids:
                    arrays["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(arrays)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(rows, IDS_SCHEMA if with_ids else PIECES_SCHEMA)


class _Sizes:
    """How many pieces there are of each length; a bit set finds the next length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1).tolist()
        self.bits = sum(1 << n for n in range(1, capacity + 1) if self.count[n])

    def largest(self, most: int) -> int:
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits ^= 1 << n

    def give(self, n: int) -> None:
        if not self.count[n]:
            self.bits |= 1 << n
        self.count[n] += 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Fillings by best fit over decreasing lengths; the bit set holds the gaps in use."""
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, fillings = 0, []
    for n in np.sort(lengths)[::-1].tolist():
        at = bits >> n
        if at and n:
            gap = n + (at & -at).bit_length() - 1
            which = gaps[gap].pop()
            if not gaps[gap]:
                bits ^= 1 << gap
        else:
            gap, which = capacity, len(fillings)
            fillings.append([])
        fillings[which].append(n)
        if left := gap - n:
            gaps[left].append(which)
            bits |= 1 << left
    return fillings


class Spent(Exception):
    """The steps of a search are used up."""


class Budget:
    """The steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def take(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent


def waste_bound(count: np.ndarray, capacity: int) -> int:
    """No packing of ``count[n]`` pieces of each length n has fewer sequences (L2).

    For each k up to half the capacity: pieces over capacity - k and over half a
    sequence need one each, and what the middle ones of at least k exceed the
    space beside the latter needs more.
    """
    lengths = np.arange(capacity + 1)
    pieces = np.cumsum(count)
    weight = np.cumsum(count * lengths)
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2
    top, over = pieces[-1] - pieces[capacity - k], pieces[capacity - k] - pieces[half]
    over_weight = weight[capacity - k] - weight[half]
    middle = weight[half] - np.where(k > 0, weight[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(middle - (over * capacity - over_weight)) // capacity))
    return int((top + over + more).max())


def replaceable(filling: tuple[int, ...], rest: list[int], slack: int) -> bool:
    """Whether some pieces of a filling can be replaced by one larger piece of ``rest`` (ascending) that fits.

    A set of two and more pieces may be replaced by one of its own sum; a single
    one, or none, only by a larger one.
    """
    singles, several = {0}, set()
    for n in filling:
        several |= {s + n for s in several} | {s + n for s in singles if s}
        singles.add(n)
    for total, own in ((t, t in several) for t in singles | several):
        at = bisect_left(rest, total if own else total + 1)
        if at < len(rest) and rest[at] <= total + slack:
            return True
    return False


def undominated(sizes: _Sizes, room: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room``, by increasing waste.

    Each waste is tried in turn, and every set of pieces that leaves it is found
    by taking lengths in falling order; a bit set of the sums that the shorter
    pieces can make ends what cannot come out. One piece that fills the room
    dominates every other filling.
    """
    if room and sizes.count[room]:
        budget.take()
        yield (room,)
        return
    present = [n for n in range(1, min(room, len(sizes.count) - 1) + 1) if sizes.count[n]]
    reach, sums, mask = [], 1, (2 << room) - 1
    for n in present:  # sums of pieces up to each length, its copies in groups of doubling size
        reach.append(sums)
        copies, group = min(sizes.count[n], room // n), 1
        while copies:
            group = min(group, copies)
            sums |= sums << n * group & mask
            copies, group = copies - group, 2 * group
    reach.append(sums)
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for filling in _making(sizes, present, reach, total, budget):
            budget.take(len(filling))
            left = [n for n in present if sizes.count[n] > filling.count(n)]
            if not replaceable(filling, left, room - total):
                yield filling


def _making(sizes: _Sizes, present: list[int], reach: list[int], total: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """Every multiset of the pieces that has a sum, larger pieces first."""
    stack: list[tuple[int, int, tuple[int, ...]]] = [(len(present), total, ())]
    while stack:
        k, left, taken = stack.pop()
        budget.take()
        if not left:
            yield taken
            continue
        if not k or not reach[k] >> left & 1:
            continue
        n = present[k - 1]
        more = taken
        stack.append((k - 1, left, taken))
        for _ in range(min(sizes.count[n], left // n)):  # the most copies come out of the stack first
            left -= n
            more = (*more, n)
            stack.append((k - 1, left, more))


def bin_completion(lengths: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[list[int]], bool]:
    """Fillings of as few sequences as the search finds, and whether they are proven least."""
    best = best_fit_decreasing(lengths, capacity)
    least = waste_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if len(best) <= least:
        return best, True
    sizes, budget = _Sizes(lengths, capacity), Budget(steps)
    chosen: list[list[int]] = []
    stack: list[tuple[int, Iterator[tuple[int, ...]]]] = []

    def open_sequence() -> None:
        n = sizes.largest(capacity)
        sizes.take(n)
        stack.append((n, undominated(sizes, capacity - n, budget)))

    def give(pieces: Iterable[int]) -> None:
        for x in pieces:
            sizes.give(x)

    try:
        open_sequence()
        while stack:
            n, options = stack[-1]
            if len(chosen) == len(stack):  # take back what was chosen here
                give(chosen.pop()[1:])
            filling = next(options, None)
            if filling is None:
                stack.pop()
                give([n])
                continue
            budget.take(10)
            for x in filling:
                sizes.take(x)
            chosen.append([n, *filling])
            if not sizes.bits:
                best = [list(x) for x in chosen]
                if len(best) <= least:
                    break
            elif len(chosen) + waste_bound(np.array(sizes.count), capacity) < len(best):
                open_sequence()
                continue
            give(chosen.pop()[1:])
    except Spent:
        return best, False
    return best, True


def place(lengths: np.ndarray, capacity: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """The sequence and the offset of every piece, how many sequences there are, and whether they are proven least."""
    fillings, proven = bin_completion(lengths, capacity, steps)
    order = np.argsort(-lengths, kind="stable")
    flat = np.array([n for filling in fillings for n in filling], np.int64)
    which = np.repeat(np.arange(len(fillings)), [len(x) for x in fillings])
    starts = np.cumsum(flat) - flat
    first = np.r_[0, np.cumsum([sum(x) for x in fillings])[:-1]]
    offsets = starts - first[which]
    slot = np.argsort(-flat, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence[order], offset[order] = which[slot], offsets[slot]
    return sequence, offset, len(fillings), proven


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK_PIECES, steps: int = STEPS) -> DataFrame:
    """Adds sequence_id, offset and proven to rows that have doc_id, piece and length.

    ``proven``: no packing of the row's part, of about ``chunk`` pieces, has
    fewer sequences. The rows are checkpointed and dealt out evenly, so that no
    doc_id, null or repeated, comes to one task.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("proven", T.BooleanType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, n = TaskContext.get().partitionId() << 36, [], 0

        def placed() -> pa.Table:
            nonlocal base
            whole = pa.Table.from_batches(held)
            sequence, offset, used, proven = place(whole.column("length").to_numpy(), capacity, steps)
            sequence, base = sequence + base, base + used
            whole = whole.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return whole.append_column("proven", pa.array(np.full(len(sequence), proven))).combine_chunks()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 2 * chunk:
                yield from placed().to_batches()
                held, n = [], 0
        if held:
            yield from placed().to_batches()

    ready = durable(pieces)
    return ready.repartition(max(1, -(-ready.count() // chunk))).mapInArrow(rows, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack the pieces."""
    return pack(token_pieces(docs, path, capacity, with_ids=with_ids), capacity)
