"""Observation: the settings of one analysis of one experiment."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

REGULAR = "regular"
PLANNING = "planning"


@dataclass(frozen=True)
class Observation:
    """What to compute and on which units.

    Windows are closed intervals (both ends included), as TIMESTAMP_NTZ wall clock.

    * ``exposure_start .. exposure_end`` – a unit counts if its exposure time falls here;
    * ``calc_start .. calc_end`` – event rows that feed the unit formulas;
    * events are read in ``exposure_start .. calc_end`` only.
    """

    name: str
    split_id: str
    exposure_start: datetime
    exposure_end: datetime
    calc_start: datetime
    calc_end: datetime
    experiment_name: str | None = None
    exposure_event: str | None = None
    filters: tuple[str, ...] = ()
    keep_inactive_units: bool = False
    audience_join: str = "semi"  # "semi": intersect audiences; "inner": literal join, repeats multiply rows
    exposure_rule: str = "first"  # "first": first exposure, dropped if before split; "first_after_split"
    purpose: str = REGULAR
    observation_id: int | None = None
    experiment_id: int | None = None
    metric_tags: tuple[str, ...] | None = None
    metric_groups: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.audience_join not in ("semi", "inner"):
            raise ValueError("audience_join must be 'semi' or 'inner'")
        if self.exposure_rule not in ("first", "first_after_split"):
            raise ValueError("exposure_rule must be 'first' or 'first_after_split'")
        if self.purpose not in (REGULAR, PLANNING):
            raise ValueError("purpose must be 'regular' or 'planning'")
        if self.exposure_end < self.exposure_start or self.calc_end < self.calc_start:
            raise ValueError("window end before start")

    def as_planning(self) -> "Observation":
        return replace(self, purpose=PLANNING)

    @property
    def reference_days(self) -> int:
        return (self.exposure_end - self.exposure_start).days


def submitted(audience_tables: tuple[str, ...] = (), custom_query: str | None = None, spark=None, **fields) -> Observation:
    """An observation from fields that a user typed in: ValueError naming every field that
    holds an injection pattern, and a custom assignment query must be read-only."""
    from ..operators.guard import ensure_read_only, field_violations

    typed = {k: fields.get(k) for k in ("experiment_name", "split_id", "exposure_event", "filters")}
    bad = field_violations(typed | {"audience_tables": audience_tables})
    if bad:
        raise ValueError("; ".join(f"{name}: {code} in {text!r}" for name, text, code in bad))
    if custom_query and custom_query.strip():
        ensure_read_only(custom_query, spark)
    return Observation(**fields)
