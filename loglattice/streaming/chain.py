"""The unfinalised end of a chain: what may still be rolled back, and where two chains part.

Pure driver-side bookkeeping over at most a thousand block references.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

DEPTH = 1024


class Block(NamedTuple):
    number: int
    hash: str


class ForkError(RuntimeError):
    """A fork that cannot be resolved."""


def common_prefix(ours: list[Block], theirs: list[Block]) -> int:
    """The place in ``ours`` of the last block that both ascending chains share, -1 if none.

    Heights that only one chain has are passed over; the first height at which
    the hashes differ ends the search.
    """
    other = {b.number: b.hash for b in theirs}
    last = -1
    for k, block in enumerate(ours):
        if block.number in other:
            if other[block.number] != block.hash:
                break
            last = k
    return last


@dataclass
class ForkTracker:
    """Blocks above the finalised head, ascending."""

    finalized: Block | None = None
    chain: list[Block] = field(default_factory=list)
    depth: int = DEPTH

    def push(self, block: Block) -> None:
        """A height again replaces it; lower ones, and final ones, are ignored."""
        if self.finalized and block.number <= self.finalized.number:
            return
        if self.chain and block.number < self.chain[-1].number:
            return
        if self.chain and block.number == self.chain[-1].number:
            self.chain.pop()
        self.chain.append(block)
        del self.chain[: -self.depth]

    def finalize(self, block: Block | None) -> None:
        """The finalised head only rises; blocks up to it leave the chain."""
        if block and (self.finalized is None or block.number > self.finalized.number):
            self.finalized = block
            self.chain = [b for b in self.chain if b.number > block.number]

    def resolve(self, theirs: list[Block]) -> Block:
        """Rolls back to the last block shared with ``theirs`` and returns it.

        If all of theirs lie below the finalised head, that head is the answer;
        another hash at its height, or nothing shared, is an error.
        """
        if not theirs:
            raise ForkError("the other chain is empty")
        final = self.finalized
        at_final = next((b for b in theirs if final and b.number == final.number), None)
        if at_final and at_final.hash != final.hash:
            raise ForkError("the finalised head differs")
        above = [b for b in theirs if not final or b.number > final.number]
        shared = common_prefix(self.chain, above)
        if shared >= 0:
            del self.chain[shared + 1 :]
            return self.chain[-1]
        if at_final or (final and not above):
            self.chain.clear()
            return final
        raise ForkError("the chains share no block" if final else "the chains share no block, and none is final")

    def handle(self, theirs: list[Block]) -> Block | None:
        """Like ``resolve``; without a finalised head nothing is kept if nothing is shared."""
        try:
            return self.resolve(theirs)
        except ForkError:
            if self.finalized is None and theirs:
                self.chain.clear()
                return None
            raise


def effective_finalized(blocks: list[Block], header: Block | None, before: Block | None) -> Block | None:
    """The last fetched block that is not above the finalised head that the source tells; it never goes back."""
    below = [b for b in blocks if header and b.number <= header.number]
    found = max(below, default=None, key=lambda b: b.number)
    return max((b for b in (found, before) if b), default=None, key=lambda b: b.number)


@dataclass
class Checkpoint:
    """How far a chain is stored: its last block, the finalised one, and the chain between."""

    current: Block
    finalized: Block | None = None
    rollback: list[Block] = field(default_factory=list)


@dataclass
class ResumePoint:
    """Where to go on: everything above ``block`` is deleted first."""

    block: Block
    tracker: ForkTracker


def resume(saved: Checkpoint | None) -> ResumePoint | None:
    """The finalised block if one is saved, else the last with the chain to roll back along."""
    if saved is None:
        return None
    if saved.finalized:
        return ResumePoint(saved.finalized, ForkTracker(saved.finalized))
    return ResumePoint(saved.current, ForkTracker(None, list(saved.rollback)))


def gate(wanted: Block, durable: int | None, finalized: Block | None, chain: list[Block]) -> Block | None:
    """The last block a checkpoint may name: not above what state is durable to, nor above the finalised head."""
    most = min([wanted.number, *([durable] if durable is not None else []), *([finalized.number] if finalized else [])])
    if most == wanted.number:
        return wanted
    known = [b for b in [*chain, *([finalized] if finalized else [])] if b.number <= most]
    return max(known, default=None, key=lambda b: b.number)
