"""Keyed state of streams."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FirstSighting(StatefulProcessor):
    """Value state of one bucket of articles: when each was last let through.

    The whole bucket is one state and one timer, that of its oldest article: a
    call of the state store costs as much as some hundred rows."""

    def __init__(self, names: list[str], lifetime: int):
        self.names, self.lifetime = names, lifetime

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("bucket", "article array<string>, at array<bigint>, timer bigint")

    def _stored(self) -> tuple[dict[str, int], int | None]:
        stored = self.seen.get()
        return (dict(zip(stored[0], stored[1], strict=True)), stored[2]) if stored else ({}, None)

    def _keep(self, seen: dict[str, int], timer: int | None, fired: bool = False) -> None:
        """Store what lives on and move the timer."""
        after = (min(seen.values()) + self.lifetime) // 1000 + 1 if seen else None
        if timer is not None and timer != after and not fired:
            self.handle.deleteTimer(timer)
        if after is not None and (timer != after or fired):
            self.handle.registerTimer(after)
        if seen:
            self.seen.update((list(seen), list(seen.values()), after))
        else:
            self.seen.clear()

    def _living(self, seen: dict[str, int], timerValues) -> dict[str, int]:
        end = timerValues.getCurrentWatermarkInMs() * 1000 - self.lifetime
        return {article: at for article, at in seen.items() if at > end}

    def handleInputRows(self, key, rows, timerValues):
        seen, timer = self._stored()
        before, waiting = len(seen), []
        for row in rows:
            article, us = row["_article"], row["_us"]
            if us is None:
                yield Row(**{n: row[n] for n in self.names})
            elif article not in seen or us >= seen[article] + self.lifetime:
                waiting.append((us, row["_tie"], article, len(waiting), row))
        changed = False
        for us, _, article, _, row in sorted(waiting):
            at = seen.get(article)
            if at is None or us >= at + self.lifetime:
                seen[article] = us
                changed = True
                yield Row(**{n: row[n] for n in self.names})
        if before:
            seen = self._living(seen, timerValues)
        if changed or len(seen) != before:
            self._keep(seen, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        seen, timer = self._stored()
        # a bucket that had rows in this tick has moved its timer already
        if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs():
            self._keep(self._living(seen, timerValues), timer, fired=True)
        return iter([])

    def close(self) -> None:
        pass
