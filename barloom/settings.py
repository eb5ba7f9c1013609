"""Settings: defaults, overlaid by a JSON, INI or .env file, overlaid by the environment."""

from __future__ import annotations

import configparser
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any

# fixed values: parameters of the indicators by the names that settings files have
INDICATORS: dict[str, dict[str, Any]] = {
    "supertrend": {"atr_length": 10, "factor": 3, "training_length": 100, "kmeans_settings": {"high_volatility_percentile": 0.75, "medium_volatility_percentile": 0.50, "low_volatility_percentile": 0.25}},
    "logistic_regression": {"lookback": 10, "norm_lookback": 10, "learning_rate": 0.0009, "iterations": 1000, "filter_signals_by": "None", "use_price_data": True, "holding_period": 5},
    "rsi": {"period": 14, "overbought": 70, "oversold": 30, "filter_signals_by": "Both", "holding_period": 3},
    "macd": {"fast_period": 12, "slow_period": 26, "signal_period": 9, "filter_signals_by": "Volatility", "holding_period": 5},
    "stochastic": {"k_period": 14, "d_period": 3, "overbought": 80, "oversold": 20, "smoothing": 3, "filter_signals_by": "None", "holding_period": 3},
    "cci": {"period": 20, "overbought": 100, "oversold": -100, "filter_signals_by": "None", "holding_period": 3},
    "adx": {"period": 14, "threshold": 25, "filter_signals_by": "None", "holding_period": 3},
    "bollinger_bands": {"period": 20, "deviations": 2, "filter_signals_by": "None", "holding_period": 3},
    "williams_r": {"period": 14, "overbought": -20, "oversold": -80, "filter_signals_by": "None", "holding_period": 3},
    "knn": {"short_period": 14, "long_period": 28, "base_neighbors": 252},
    "lorentzian": {"general_settings": {"neighbors_count": 8, "max_bars_back": 2000}},
}


def merged(base: Mapping, over: Mapping) -> dict:
    """base with the values of over, a level down where both have a group."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}}


class Settings:
    """Nested values by keys, with a default for what is missing."""

    def __init__(self, values: Mapping):
        self.values = values

    def get(self, *keys: str, default: Any = None) -> Any:
        x: Any = self.values
        for k in keys:
            if not isinstance(x, Mapping) or k not in x:
                return default
            x = x[k]
        return x


def environment(prefix: str = "BARLOOM_", env: Mapping[str, str] | None = None) -> dict:
    """BARLOOM_A__B=x as {"a": {"b": x}}; values are JSON where they can be read as such."""
    out: dict = {}
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(prefix):
            *path, last = name.removeprefix(prefix).lower().split("__")
            at = out
            for k in path:
                at = at.setdefault(k, {})
            try:
                at[last] = json.loads(value)
            except ValueError:
                at[last] = value
    return out


def dotenv(text: str) -> dict[str, str]:
    """NAME=value lines, quoted or not; comments, empty lines and a leading "export" are passed over."""
    out = {}
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and not name.startswith("#"):
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
            out[name.strip()] = value[1:-1] if quoted else value.partition(" #")[0].strip()
    return out


def load(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    values: dict = {"indicators": INDICATORS}
    if path and Path(path).exists():
        if path.endswith(".ini"):
            ini = configparser.ConfigParser()
            ini.read(path)
            found: dict = {s: dict(ini[s]) for s in ini.sections()}
        elif Path(path).name.endswith(".env"):
            found = environment(env=dotenv(Path(path).read_text()))
        else:
            found = json.loads(Path(path).read_text())
        values = merged(values, found)
    return Settings(merged(values, environment(env=env)))
