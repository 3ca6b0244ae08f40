"""Network-aware portfolio analytics on Spark DataFrames."""

from arborfolio.config import BacktestConfig, CalculationError, DampenConfig, DataValidationError, InputError, NotFoundError, PortfolioError, get_logger, make_config, make_dampen_config

__all__ = ["BacktestConfig", "CalculationError", "DampenConfig", "DataValidationError", "InputError", "NotFoundError", "PortfolioError", "get_logger", "make_config", "make_dampen_config"]
