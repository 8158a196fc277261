"""How much of a source a micro-batch takes, how it is cut into tasks, and how often a task may ask.

Spark plans the work: a micro-batch is admitted by blocks, its blocks that are
final are read by parallel tasks, and only the end that may still fork is read
in one piece behind its parent. How many blocks are admitted follows from the
blocks a second that the batches before took.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

#: Seconds that a micro-batch should take, and the bounds of its blocks.
TARGET_SECONDS, FIRST_BLOCKS, LEAST_BLOCKS, MOST_BLOCKS = 6.0, 5_000, 100, 500_000
#: Requests of a task before it fails, and blocks behind the final head that count as settled.
ATTEMPTS, SETTLED = 8, 512


@dataclass
class Admission:
    """Blocks for the next micro-batch, in proportion to the throughput seen."""

    target: float = TARGET_SECONDS
    least: int = LEAST_BLOCKS
    most: int = MOST_BLOCKS
    rate: float | None = None

    def seen(self, blocks: int, seconds: float) -> None:
        """A finished micro-batch; the mean gives the newest one half of the weight."""
        if blocks > 0 and seconds > 0:
            rate = blocks / seconds
            self.rate = rate if self.rate is None else (self.rate + rate) / 2

    @property
    def blocks(self) -> int:
        wanted = FIRST_BLOCKS if self.rate is None else round(self.rate * self.target)
        return min(self.most, max(self.least, wanted))


def tasks(start: int, end: int, final: int | None, size: int) -> list[tuple[int, int]]:
    """Ranges, ends included: those of settled blocks have ``size`` blocks, the end that may fork is one.

    ``final`` is the final head where the source tells it; without one everything is settled.
    """
    settled = end if final is None else min(end, final - SETTLED)
    cuts = [(a, min(a + size - 1, settled)) for a in range(start, settled + 1, size)]
    rest = max(start, settled + 1)
    return [*cuts, (rest, end)] if rest <= end else cuts


@dataclass
class RequestRate:
    """At most ``burst`` requests at once and ``rate`` a second in the long run."""

    rate: float = 5.0
    burst: float = 50.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    #: The time from which on the allowance is whole again.
    whole_at: float = field(default=float("-inf"))

    def take(self) -> None:
        """Waits until one more request is allowed."""
        now = self.clock()
        self.whole_at = max(self.whole_at, now) + 1 / self.rate
        late = self.whole_at - now - self.burst / self.rate
        if late > 0:
            self.sleep(late)

    def share(self, readers: int) -> RequestRate:
        """The part of one of several readers."""
        n = max(1, readers)
        return RequestRate(self.rate / n, max(1.0, self.burst / n), self.clock, self.sleep)


def pause(failures: int, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: a random share of a bound that doubles up to eight seconds."""
    return min(8.0, 0.25 * 2**failures) * (0.5 + 0.5 * draw())
