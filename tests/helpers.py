from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)
OBS = (
    "series_key string, source_record_id string, observed_at timestamp, water_level_m double, "
    "station_code string, station_name string, quality_flag string"
)


def observations(spark, levels: dict[str, dict[float, float]]):
    """Observations from {series: {hour offset: level}}."""
    rows = [
        (key, f"{key}-{hour}", START + hour * HOUR, level, key, None, "normal")
        for key, series in levels.items()
        for hour, level in series.items()
    ]
    return spark.createDataFrame(rows, OBS)


def random_series(seed: int, hours: int = 120, keep: float = 0.8, decimals: int = 1) -> dict[float, float]:
    rng = np.random.default_rng(seed)
    values = np.round(5 + rng.normal(0, 1, hours).cumsum() * 0.3, decimals)
    kept = rng.random(hours) < keep
    kept[[0, -1]] = True
    return {h: float(values[h]) for h in range(hours) if kept[h]}


def brute_grid(series: dict[float, float], max_steps: int) -> pd.DataFrame:
    """Independent row-at-a-time grid for one hourly series."""
    hours = sorted(series)
    first, last = int(hours[0]), int(hours[-1])
    raw = [series.get(h) for h in range(first, last + 1)]
    level, imputed = list(raw), [False] * len(raw)
    i = 0
    while i < len(raw):
        if raw[i] is not None:
            i += 1
            continue
        j = i
        while j < len(raw) and raw[j] is None:
            j += 1
        if 0 < i and j < len(raw) and j - i <= max_steps:
            for k in range(i, j):
                level[k] = raw[i - 1] + (raw[j] - raw[i - 1]) * (k - i + 1) / (j - i + 1)
                imputed[k] = True
        i = j
    n = len(raw)
    a, b = int(n * 0.7), int(n * 0.15)
    segment = ["train"] * a + ["validation"] * b + ["test"] * (n - a - b)
    return pd.DataFrame(
        {
            "observed_at": [START + (first + k) * HOUR for k in range(n)],
            "level": pd.array(level, dtype="Float64"),
            "imputed": imputed,
            "segment": segment,
        }
    )


def null(value):
    """None for None, NaN and NA."""
    return None if value is None or value is pd.NA or value != value else value
