"""The analysis plan: a small, closed, declarative query description.

A plan is data, not code.  Unknown keys are rejected, every enumerated field
is checked, and the canonical JSON form is the plan's identity for caching.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

# Fixed values of the plan contract (they must equal the reference's).
SCHEMA_VERSION = "1.0"
FILTER_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in")
AGGREGATIONS = ("sum", "mean", "count", "min", "max", "ratio_total", "ratio_mean", "raw")
TIME_GRAINS = ("none", "day", "week", "month", "year")
MISSING_POLICIES = ("error", "exclude", "keep")
DUPLICATE_POLICIES = ("keep", "drop_exact")
SORTS = ("none", "asc", "desc", "label")
MAX_GROUP_BY = 3


class PlanError(ValueError):
    """A plan that cannot run: bad shape, unknown field, or a failed guard."""


def _check_keys(kind: str, data: dict, allowed: set[str]) -> None:
    unknown = set(data) - allowed - {"schema_version"}
    if unknown:
        raise PlanError(f"{kind}: unknown keys {sorted(unknown)}")
    version = data.get("schema_version", SCHEMA_VERSION)
    if version != SCHEMA_VERSION:
        raise PlanError(f"{kind}: schema_version must be {SCHEMA_VERSION!r}")


def _one_of(name: str, value: Any, options: tuple) -> None:
    if value not in options:
        raise PlanError(f"{name} must be one of {list(options)}, got {value!r}")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        _one_of("filter op", self.op, FILTER_OPS)
        if isinstance(self.value, list):
            object.__setattr__(self, "value", tuple(self.value))

    @classmethod
    def from_dict(cls, data: dict) -> "Filter":
        _check_keys("filter", data, {"field", "op", "value"})
        if "field" not in data or "op" not in data:
            raise PlanError("filter needs field and op")
        return cls(field=data["field"], op=data["op"], value=data.get("value"))

    def to_dict(self) -> dict:
        value = list(self.value) if isinstance(self.value, tuple) else self.value
        return {"field": self.field, "op": self.op, "value": value}


@dataclass(frozen=True)
class Plan:
    goal: str = ""
    group_by: tuple[str, ...] = ()
    metric: str | None = None
    denominator: str | None = None
    aggregation: str = "sum"
    filters: tuple[Filter, ...] = ()
    time_grain: str = "none"
    missing: str = "error"
    duplicates: str = "keep"
    sort: str = "none"
    unit: str = ""
    limitations: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        object.__setattr__(self, "group_by", tuple(self.group_by))
        object.__setattr__(self, "limitations", tuple(self.limitations))
        object.__setattr__(
            self,
            "filters",
            tuple(f if isinstance(f, Filter) else Filter.from_dict(f) for f in self.filters),
        )
        if len(self.group_by) > MAX_GROUP_BY:
            raise PlanError(f"group_by allows at most {MAX_GROUP_BY} fields")
        _one_of("aggregation", self.aggregation, AGGREGATIONS)
        _one_of("time_grain", self.time_grain, TIME_GRAINS)
        _one_of("missing", self.missing, MISSING_POLICIES)
        _one_of("duplicates", self.duplicates, DUPLICATE_POLICIES)
        _one_of("sort", self.sort, SORTS)
        if self.aggregation.startswith("ratio") and (not self.metric or not self.denominator):
            raise PlanError("Ratio requires numerator and denominator")

    @classmethod
    def from_dict(cls, data: dict) -> "Plan":
        allowed = {f for f in cls.__dataclass_fields__}
        _check_keys("plan", data, allowed)
        kwargs = {k: v for k, v in data.items() if k != "schema_version"}
        if "filters" in kwargs:
            kwargs["filters"] = tuple(Filter.from_dict(f) for f in kwargs["filters"])
        return cls(**kwargs)

    @classmethod
    def from_json(cls, text: str) -> "Plan":
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        out = asdict(self)
        out["group_by"] = list(self.group_by)
        out["filters"] = [f.to_dict() for f in self.filters]
        out["limitations"] = list(self.limitations)
        out["schema_version"] = SCHEMA_VERSION
        return out

    def canonical_json(self) -> str:
        """Deterministic text form: the plan's identity for result caching."""
        return json.dumps(self.to_dict(), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)

    @property
    def selected(self) -> list[str]:
        """Ordered distinct analysis fields: group keys, metric, denominator."""
        cols = [*self.group_by, *([self.metric] if self.metric else []), *([self.denominator] if self.denominator else [])]
        return list(dict.fromkeys(cols))
