"""Settings passed into operators; nothing is read from the environment behind the caller's back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    """Who "I" am, and the limits of the pipelines. `now` is always given, never the clock."""

    now: str = "2024-01-25 00:00:00"
    addresses: tuple[str, ...] = ()
    bots: tuple[str, ...] = ("no-reply@zoom.us", "noreply@zoom.us", "no-reply@zoom.com", "noreply@zoom.com")
    stale_days: int = 14
    priority_days: int = 14
    retention_days: int = 365
    overlap_hours: int = 1
    rrf_k: int = 60
    over_fetch: int = 4
    most_candidates: int | None = 50
    unscored_relevance: float = 0.5
    max_chunk: int = 800
    min_chunk: int = 50

    #: (messages, characters of each) of a prompt, by kind of model.
    cloud_budget: tuple[int, int] = (30, 2500)
    local_budget: tuple[int, int] = (15, 1000)

    def budget(self, local: bool) -> tuple[int, int]:
        return self.local_budget if local else self.cloud_budget

    def candidates(self, n: int) -> int:
        """Hits of each branch for n results; `most_candidates` None takes no more into account than n."""
        return self.over_fetch * n if self.most_candidates is None else min(self.over_fetch * n, self.most_candidates)


def identity(manual: str, accounts: str) -> tuple[str, ...]:
    """Own addresses: a comma list, and the users of `provider:user:secret;...`; lower-cased, without repeats."""
    named = [a.strip().lower() for a in manual.split(",")]
    users = [p[1].strip().lower() for p in (e.strip().split(":") for e in accounts.split(";")) if len(p) >= 2]
    return tuple(sorted({a for a in named + users if a}))


def from_settings(settings: Mapping[str, str], base: Config = Config()) -> Config:
    """A Config from named strings, as an environment or a form gives them."""
    bots = tuple(s.strip().lower() for s in settings.get("AUTOMATED_SENDERS", ",".join(base.bots)).split(",") if s.strip())
    return replace(base, addresses=identity(settings.get("MY_EMAIL_ADDRESSES", ""), settings.get("IMAP_ACCOUNTS", "")), bots=bots, retention_days=int(settings.get("RETENTION_DAYS", base.retention_days)))
