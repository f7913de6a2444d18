"""Telemetry schema, physical bounds and the default parameters of every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The thirteen metrics in their canonical order, with [low, high] physical bounds.
BOUNDS: dict[str, tuple[float | None, float | None]] = {
    "gpu_util": (0.0, 100.0),
    "mem_util": (0.0, 100.0),
    "gpu_temp": (20.0, 110.0),
    "power_watts": (0.0, 700.0),
    "ecc_errors": (0.0, None),
    "xid_errors": (0.0, None),
    "cpu_util": (0.0, 100.0),
    "ram_util": (0.0, 100.0),
    "net_throughput_mbps": (0.0, None),
    "disk_io_mbps": (0.0, None),
    "job_runtime_s": (0.0, None),
    "queue_length": (0.0, None),
    "active_processes": (0.0, None),
}
METRICS: tuple[str, ...] = tuple(BOUNDS)

KEY = "gpu_id"
TIME = "timestamp"
HOST = "node_id"
SEQ = "seq"  # arrival order; decides which copy of a sample is the last one
IDENTIFIERS = (TIME, KEY, HOST)
ALL_COLUMNS = IDENTIFIERS + METRICS
WINDOW_END = "window_end_timestamp"

# Workload classes, indexed by label.
WORKLOAD_CLASSES = ("idle", "light", "steady", "bursty")

# Exporter metric behind each column.
EXPORTER_METRICS: dict[str, str] = {
    "gpu_util": "DCGM_FI_DEV_GPU_UTIL",
    "mem_util": "DCGM_FI_DEV_MEM_COPY_UTIL",
    "gpu_temp": "DCGM_FI_DEV_GPU_TEMP",
    "power_watts": "DCGM_FI_DEV_POWER_USAGE",
    "ecc_errors": "DCGM_FI_DEV_ECC_SBE_VOL_TOTAL",
    "xid_errors": "DCGM_FI_DEV_XID_ERRORS",
    "cpu_util": "node_cpu_utilization",
    "ram_util": "node_memory_utilization",
    "net_throughput_mbps": "node_network_receive_bytes_total",
    "disk_io_mbps": "node_disk_io_bytes_total",
    "job_runtime_s": "job_runtime_seconds",
    "queue_length": "scheduler_queue_length",
    "active_processes": "DCGM_FI_DEV_COMPUTE_PIDS",
}

TELEMETRY = T.StructType(
    [
        T.StructField(TIME, T.TimestampNTZType()),
        T.StructField(KEY, T.StringType()),
        T.StructField(HOST, T.StringType()),
    ]
    + [T.StructField(m, T.DoubleType()) for m in METRICS]
)

STATISTICS = ("mean", "std", "max")
STAT_COLUMNS = tuple(f"{m}_{s}" for m in METRICS for s in STATISTICS)


# The defaults of the three classes below.
@dataclass(frozen=True)
class WindowSpec:
    """Row-count windows: `size` rows each, a new one every `stride` rows."""

    size: int = 30
    stride: int = 5

    def __post_init__(self) -> None:
        if self.size < 1 or self.stride < 1:
            raise ValueError("window size and stride must be positive")


@dataclass(frozen=True)
class RiskWeights:
    anomaly: float = 0.35
    ecc_xid: float = 0.25
    thermal: float = 0.20
    utilization_stability: float = 0.20


@dataclass(frozen=True)
class RiskTiers:
    low: float = 0.33
    medium: float = 0.66


def metric_columns(columns) -> list[str]:
    """The metrics present in `columns`, in canonical order."""
    present = set(columns)
    return [m for m in METRICS if m in present]


def null_if_nan(column: Column) -> Column:
    """Missing values are NULL everywhere past a source; NaN becomes NULL there."""
    return F.nanvl(column, F.lit(None).cast("double"))
