"""Settings and errors."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields
from typing import Any

#: What counts as zero, trading days and months of a year.
EPSILON, YEAR_DAYS, YEAR_MONTHS = 1e-12, 252, 12


def get_logger(name: str = "arborfolio") -> logging.Logger:
    """The library's logger; where its messages go is left to the program."""
    return logging.getLogger(name)


class PortfolioError(Exception):
    """Base of all errors; context holds what the message is about."""

    def __init__(self, message: str, **context: Any) -> None:
        super().__init__(message)
        self.context = context

    def __str__(self) -> str:
        return super().__str__() + "".join(f"; {k}={v}" for k, v in self.context.items())


class DataValidationError(PortfolioError):
    """A table breaks a rule."""


class InputError(PortfolioError, ValueError):
    """A setting or argument is out of bounds."""


class CalculationError(PortfolioError):
    """A result is undefined."""


class NotFoundError(PortfolioError, FileNotFoundError):
    """A file isn't there."""


def _need(ok: bool, name: str, value: Any, rule: str) -> None:
    if not ok:
        raise InputError(f"{name} must be {rule}", value=value)


@dataclass(frozen=True)
class DampenConfig:
    window: int = 63
    threshold: float = 3.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "window", int(self.window))
        object.__setattr__(self, "threshold", float(self.threshold))
        _need(self.window >= 2, "window", self.window, "2 or more")
        _need(0 < self.threshold < float("inf"), "threshold", self.threshold, "positive")


@dataclass(frozen=True)
class BacktestConfig:
    estimation_months: int = 24
    transaction_cost_bps: float = 0.0
    centrality_normalization: str = "l2"
    weight_normalization: str = "inverse_proportional"
    adjacency_weighting: str = "correlation_distance"
    return_preprocessing: str = "raw"
    window: int = 63
    threshold: float = 3.0

    def __post_init__(self) -> None:
        for name in ("estimation_months", "window"):
            object.__setattr__(self, name, int(getattr(self, name)))
        for name in ("transaction_cost_bps", "threshold"):
            object.__setattr__(self, name, float(getattr(self, name)))
        _need(self.estimation_months >= 1, "estimation_months", self.estimation_months, "1 or more")
        _need(0 <= self.transaction_cost_bps < float("inf"), "transaction_cost_bps", self.transaction_cost_bps, "0 or more")
        for name, choices in (("centrality_normalization", ("l2",)), ("weight_normalization", ("paper_softmax", "inverse_proportional")), ("adjacency_weighting", ("correlation_distance", "unweighted")), ("return_preprocessing", ("raw", "AMAD"))):
            _need(getattr(self, name) in choices, name, getattr(self, name), f"one of {', '.join(choices)}")
        DampenConfig(self.window, self.threshold)

    @property
    def dampened(self) -> bool:
        return self.return_preprocessing == "AMAD"

    @property
    def label(self) -> str:
        return f"NRP-{self.return_preprocessing}"


def _made(kind: type, given: Any) -> Any:
    given = {} if given is None else given
    if isinstance(given, kind):
        return given
    if not isinstance(given, dict):
        raise InputError(f"{kind.__name__} takes a mapping", value=type(given).__name__)
    if unknown := given.keys() - {f.name for f in fields(kind)}:
        raise InputError("unknown settings", names=sorted(unknown))
    try:
        return kind(**given)
    except (TypeError, ValueError) as bad:
        if isinstance(bad, InputError):
            raise
        raise InputError(str(bad)) from bad


def make_config(config_input: Any = None) -> BacktestConfig:
    return _made(BacktestConfig, config_input)


def make_dampen_config(config_input: Any = None) -> DampenConfig:
    return _made(DampenConfig, config_input)
