"""Small telemetry tables written out by hand or drawn from a seed, and a pandas view of cleaning."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from gaugeworks.schema import BOUNDS, METRICS, SEQ

START = datetime(2024, 1, 1)


def rows_of(device: str, values: list, step_seconds=60, metric="gpu_util", seq_from=0, start=START):
    """One row per value: that metric has the value, the others are 1."""
    out = []
    for i, value in enumerate(values):
        offset = sum(step_seconds[:i]) if isinstance(step_seconds, list) else i * step_seconds
        row = {SEQ: seq_from + i, "timestamp": start + timedelta(seconds=offset), "gpu_id": device, "node_id": "n"}
        row.update({m: (30.0 if m == "gpu_temp" else 1.0) for m in METRICS})
        row[metric] = value
        out.append(row)
    return out


SCHEMA = f"{SEQ} bigint, timestamp timestamp_ntz, gpu_id string, node_id string, " + ", ".join(
    f"{m} double" for m in METRICS
)


def frame(spark, rows: list[dict]):
    columns = [SEQ, "timestamp", "gpu_id", "node_id", *METRICS]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], SCHEMA)


def random_rows(seed: int, lengths: dict[str, int], missing: float = 0.2) -> list[dict]:
    """Noisy series with gaps, values out of bounds, rare spikes, uneven steps and repeated samples."""
    rng = np.random.default_rng(seed)
    out, seq = [], 0
    for device, n in lengths.items():
        time = START
        for _ in range(n):
            time += timedelta(seconds=int(rng.integers(1, 5_000)))
            for _ in range(1 + (rng.random() < 0.1)):
                row = {SEQ: seq, "timestamp": time, "gpu_id": device, "node_id": "n"}
                for m in METRICS:
                    value = float(rng.normal(50, 30)) * (40 if rng.random() < 0.01 else 1)
                    row[m] = None if rng.random() < missing else value
                out.append(row)
                seq += 1
    rng.shuffle(out)
    return out


def cleaned(rows: list[dict], threshold: float) -> pd.DataFrame:
    """Brute force with numpy, one device at a time."""
    table = pd.DataFrame(rows).sort_values(SEQ).drop_duplicates(["gpu_id", "timestamp"], keep="last")
    parts = []
    for _, group in table.sort_values("timestamp").groupby("gpu_id"):
        group = group.copy()
        at = np.arange(len(group))
        for m in METRICS:
            x = group[m].to_numpy(dtype="float64")
            known = ~np.isnan(x)
            if known.any():
                x = np.interp(at, at[known], x[known])
                low, high = BOUNDS[m]
                x = np.clip(x, low, high if high is not None else np.inf)
                mean, std = x.mean(), x.std()
                if std > 0:
                    x = np.clip(x, mean - threshold * std, mean + threshold * std)
            group[m] = x
        parts.append(group)
    return pd.concat(parts).sort_values(["gpu_id", "timestamp"]).reset_index(drop=True)
