"""What a request asks for, validated on the driver: source scope, retrieval strategy, snapshot scope."""

from __future__ import annotations

from dataclasses import dataclass

from feedlens.functions.text import scope_fingerprint

STAGES = ("sourceScope", "profilePolicy", "interestRefinement", "qualityNoise", "ranking")


def distinct(values: tuple[str, ...] | list[str] | None) -> tuple[str, ...]:
    """Trimmed, non-empty, each once, in order."""
    return tuple(dict.fromkeys(v.strip() for v in values or () if v and v.strip()))


@dataclass(frozen=True)
class SourceScope:
    """A hard scope; one feed outranks all tracked sources, which outrank a group."""

    feed_id: str = ""
    group: str = "all"
    tracked_all: bool = False

    @property
    def kind(self) -> str:
        if self.feed_id.strip():
            return "feed"
        group = self.group.strip() or "all"
        if self.tracked_all and group == "all":
            return "tracked_all"
        return "global" if group == "all" else "group"


@dataclass(frozen=True)
class Contract:
    """A filter request; a profile is required as soon as it has an id."""

    source: SourceScope = SourceScope()
    profile_id: str = ""
    profile_version: int = 1
    interests: tuple[tuple[str, tuple[str, ...]], ...] = ()
    search: str = ""
    quality: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "profile_version", max(1, int(self.profile_version or 1)))
        object.__setattr__(self, "interests", tuple((g.strip(), distinct(v)) for g, v in self.interests if g.strip()))
        object.__setattr__(self, "search", self.search.strip())

    @property
    def retrieval(self) -> str:
        """complete with a profile, progressive with a search, bounded else."""
        if self.profile_id.strip():
            return "complete"
        return "progressive" if self.search else "bounded"

    def scope_key(self, include_duplicates: bool = False) -> str:
        """Names the snapshot that this request may read; order of interests doesn't matter."""
        return scope_fingerprint({"source": [self.source.kind, self.source.feed_id, self.source.group], "profile": self.profile_id, "interests": sorted([g, sorted(v)] for g, v in self.interests), "search": self.search, "duplicates": include_duplicates})


class SnapshotError(ValueError):
    """A page request that its snapshot can't serve; code is one of scope_mismatch, expired, invalid_page, too_large."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


def check_page(scope_key: str, stored_key: str, created: float, now: float, page: int, ttl: float = 60.0) -> None:
    """Refuses a page of another scope's or an expired snapshot, and page numbers under 1."""
    if scope_key != stored_key:
        raise SnapshotError("scope_mismatch")
    if now - created > ttl:
        raise SnapshotError("expired")
    if page < 1:
        raise SnapshotError("invalid_page")
