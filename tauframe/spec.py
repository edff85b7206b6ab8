"""Roles of the columns in a unit-level table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class CausalSpec:
    """Names of the id, arm, outcome, covariate and stratum columns.

    The arm column is an integer, 0 for control and 1 for treated, unless an
    operator says it accepts several arms.
    """

    id: str
    treatment: str
    outcome: str
    covariates: tuple[str, ...] = field(default_factory=tuple)
    stratum: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "covariates", tuple(self.covariates))

    def with_covariates(self, covariates) -> "CausalSpec":
        return replace(self, covariates=tuple(covariates))
