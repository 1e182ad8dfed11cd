"""Per-user sliding-window admission over time-ordered rows: the small state machine inside the tasks."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import deque

from ..rules import RateLimits

WINDOW_US = 60_000_000
HOUR_US = 3_600_000_000

RELEASED, ADMITTED, BUSY, MINUTE, HOURLY, TOKENS = range(6)


def messages(limits: RateLimits) -> dict[int, str]:
    """The text of each denial."""
    return {
        BUSY: f"Concurrent request limit ({limits.concurrent_requests}) exceeded",
        MINUTE: f"Rate limit ({limits.requests_per_minute}/min) exceeded",
        HOURLY: f"Rate limit ({limits.requests_per_hour}/hour) exceeded",
        TOKENS: f"Token limit ({limits.tokens_per_minute}/min) exceeded",
    }


class UserLog:
    """What a user's past means for the next request: admitted requests of the last minute (or hour)
    and open requests. Its size is bounded by the limits, not by the user's history."""

    def __init__(self, limits: RateLimits, saved: str | None = None):
        self.limits = limits
        past = json.loads(saved) if saved else [0, [], [], []]
        self.active: int = past[0]
        self.times = deque(past[1])
        self.tokens = deque(map(tuple, past[2]))
        self.hour = deque(past[3])
        self.token_sum = sum(n for _, n in self.tokens)

    def forget(self, now: int) -> None:
        """Drop what is at least a minute (an hour) old."""
        edge = now - WINDOW_US
        while self.times and self.times[0] <= edge:
            self.times.popleft()
        while self.tokens and self.tokens[0][0] <= edge:
            self.token_sum -= self.tokens.popleft()[1]
        while self.hour and self.hour[0] <= now - HOUR_US:
            self.hour.popleft()

    def save(self) -> str:
        return json.dumps([self.active, list(self.times), list(self.tokens), list(self.hour)])

    def is_blank(self) -> bool:
        return not (self.active or self.times or self.hour)

    def expires_at(self) -> int:
        """When the window will be empty if nothing more is admitted."""
        last = self.times[-1] + WINDOW_US if self.times else 0
        return max(last, self.hour[-1] + HOUR_US if self.hour else 0)

    def decide(self, ts: list[int], released: list[bool], tokens: list[int]) -> list[int]:
        """Decision codes for the user's next rows, in order.

        While a user stands at a limit that only time or a release can lift, the rows up to that
        moment are denied together, so a flood costs little more than reading it.
        """
        lim = self.limits
        n = len(ts)
        releases = [i for i, r in enumerate(released) if r]
        out = [BUSY] * n
        i = next_at = 0
        while i < n:
            while next_at < len(releases) and releases[next_at] < i:
                next_at += 1
            stop = releases[next_at] if next_at < len(releases) else n
            if i == stop:
                self.active = max(0, self.active - 1)
                out[i] = RELEASED
                i += 1
                continue
            now = ts[i]
            self.forget(now)
            if self.active >= lim.concurrent_requests:
                i = stop
                continue
            if len(self.times) >= lim.requests_per_minute:
                code, until = MINUTE, (self.times[0] + WINDOW_US if self.times else None)
            elif lim.requests_per_hour is not None and len(self.hour) >= lim.requests_per_hour:
                code, until = HOURLY, (self.hour[0] + HOUR_US if self.hour else None)
            else:
                if self.token_sum + tokens[i] > lim.tokens_per_minute:
                    out[i] = TOKENS
                else:
                    out[i] = ADMITTED
                    self.active += 1
                    self.times.append(now)
                    if tokens[i] > 0:
                        self.tokens.append((now, tokens[i]))
                        self.token_sum += tokens[i]
                    if lim.requests_per_hour is not None:
                        self.hour.append(now)
                i += 1
                continue
            end = stop if until is None else bisect_left(ts, until, i, stop)
            out[i:end] = [code] * (end - i)
            i = end
        if n:
            self.forget(ts[-1])
        return out
