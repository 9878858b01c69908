"""Query parameters, checked and defaulted before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field

PAGE_SIZE = 50


@dataclass(frozen=True)
class Filters:
    """None means no predicate; True or False never match a null."""

    favorited: bool | None = None
    archived: bool | None = None
    trashed: bool | None = None
    ext: str | None = None


@dataclass(frozen=True)
class SortCriterion:
    scorer_id: str
    variant_id: str
    metric_key: str
    descending: bool = True
    min_score: float | None = None
    max_score: float | None = None


@dataclass(frozen=True)
class BrowseQuery:
    filters: Filters = Filters()
    criteria: tuple[SortCriterion, ...] = field(default=())
    dedupe: bool = True
    page: int = 1
    page_size: int = PAGE_SIZE

    @property
    def offset(self) -> int:
        return max(0, (self.page - 1) * self.page_size)


def parse_score(raw: str | float | None) -> float | None:
    """A number, or None for blank or invalid input."""
    if raw is None:
        return None
    try:
        return float(str(raw).strip())
    except ValueError:
        return None


def parse_sort(raw: str | None) -> tuple[str, str, str] | None:
    """``scorer:variant:metric``, exactly three non-empty parts, else None."""
    parts = (raw or "").split(":")
    return tuple(parts) if len(parts) == 3 and all(parts) else None  # type: ignore[return-value]


def parse_levels(levels: list[dict]) -> tuple[SortCriterion, ...]:
    """Sort levels up to the first invalid one; ranges count only with a valid sort."""
    out = []
    for level in levels[:4]:
        key = parse_sort(level.get("sort_by"))
        if key is None:
            break
        out.append(SortCriterion(*key, level.get("descending", True), parse_score(level.get("min_score")), parse_score(level.get("max_score"))))
    return tuple(out)


def page_count(total: int, size: int = PAGE_SIZE) -> int:
    return max(1, -(-total // size))


def page_of_rank(newer: int, size: int = PAGE_SIZE) -> int:
    """The page that the first row with `newer` rows before it stands on."""
    return max(1, newer // size + 1)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))
