"""Options and thresholds of the digitiser; plain values that become literals of a plan."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: the thresholds that results depend on
    red_min: int = 240
    red_other_max: int = 10
    gray_spread: int = 15
    gray_sat: int = 25
    gray_val: int = 25
    lum_min: float = 45.0
    lum_max: float = 150.0
    sample_limit: int = 50_000
    k_min: int = 2
    k_max: int = 20
    icm_sweeps: int = 620
    icm_colour: float = 1.0
    icm_neighbour: float = 12_000.0
    axes_margin_cluster: float = 10.0
    axes_margin_curve: float = 3.0
    tail_lookback: int = 10
    tail_tolerance: float = 2.5
    norm_floor: float = 1e-6
    max_points: int = 500_000
    min_preprune: float = 0.2
    min_coverage: float = 0.40
    min_points: int = 12
    max_roughness: float = 5000.0
    roughness_samples: int = 200
    roughness_method: str = "mean_squared"
    feature_space: str = "lab"
    spike_factor: float = 3.0
    spike_pair: float = 1.0
    spike_passes: int = 10
    spike_floor: float = 0.30
    rolling_window: int = 51
    rolling_sigma: float = 2.0
    rolling_fraction: float = 0.20
    rolling_passes: int = 5
    reassign_fraction: float = 0.05
    reassign_margin: float = 0.8
    reassign_passes: int = 3
    marker_area: int = 20
    fast_grid: dict = field(default_factory=lambda: {"sat": (0.8, 1.0, 1.2, 1.45, 1.8, 3.6, 8.0), "val": (1.0,), "contrast": (1.0,), "ratio": (0.55, 0.65, 0.75, 0.85, 0.95)})
    full_grid: dict = field(
        default_factory=lambda: {
            "sat": (0.8, 1.0, 1.2, 1.45, 1.8, 3.6, 8.0, 12.0, 16.0, 20.0), "val": (0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3),
            "contrast": (0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3), "ratio": (0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95),
        }
    )


    def __post_init__(self) -> None:
        if self.feature_space not in ("lab", "rgb"):
            raise ValueError(f"feature_space must be lab or rgb, not {self.feature_space!r}")
        if self.roughness_method not in ("mean_squared", "median_abs"):
            raise ValueError(f"roughness_method must be mean_squared or median_abs, not {self.roughness_method!r}")


@dataclass(frozen=True)
class DigitizeOptions:
    k: int = 100
    min_sat: int = 30
    min_val: int = 30
    knn_k: int = 3
    knn_thresh: float = 35.0
    monotone_y: bool = False
    monotone_method: str = "pava"
    auto_colors: bool = False
    exclude_grayscale: bool = True
    num_colors: int = 0
    xscale_log: bool = False
    yscale_log: bool = False
    keep_outside_axes: bool = False
    prune_auto: bool = False

    def __post_init__(self) -> None:
        if self.monotone_method not in ("pava", "clip"):
            raise ValueError(f"monotone_method must be pava or clip, not {self.monotone_method!r}")
        if self.k < 1 or self.knn_k < 1 or self.num_colors < 0:
            raise ValueError("k and knn_k must be positive, num_colors not negative")


@dataclass(frozen=True)
class Limits:
    """The data limits of images without a calibration of their own."""

    xmin: float | None = None
    xmax: float | None = None
    ymin: float | None = None
    ymax: float | None = None

    def __post_init__(self) -> None:
        given = {k: v for k, v in vars(self).items() if v is not None}
        for k, v in given.items():
            if isinstance(v, bool) or not isinstance(v, (int, float)):
                raise ValueError(f"{k} must be a number, not {v!r}")
        for a, b in (("xmin", "xmax"), ("ymin", "ymax")):
            if a in given and given.get(a) == given.get(b):
                raise ValueError(f"{a} and {b} must differ")

    def complete(self) -> Limits:
        """These limits, if all four are there."""
        missing = [k for k, v in vars(self).items() if v is None]
        if missing:
            raise ValueError(f"axis limits missing without a calibration: {', '.join(missing)}")
        return self


def exactly_three(corners: dict) -> dict:
    """The corners that are set, if they are three of tl, tr, bl, br."""
    held = {k: v for k, v in corners.items() if v is not None}
    if set(held) - {"tl", "tr", "bl", "br"} or len(held) != 3:
        raise ValueError("set exactly three of the corners tl, tr, bl, br")
    return held


@dataclass(frozen=True)
class CalibrationPoint:
    pixel: tuple[float, float]
    data: tuple[float, float]

    def __post_init__(self) -> None:
        for name, pair in (("pixel", self.pixel), ("data", self.data)):
            if pair is None or len(pair) != 2 or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in pair):
                raise ValueError(f"{name} must be two numbers, not {pair!r}")


@dataclass(frozen=True)
class AxisCalibration:
    origin: CalibrationPoint
    x_axis: CalibrationPoint
    y_axis: CalibrationPoint

    def ranges(self) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax."""
        return float(self.origin.data[0]), float(self.x_axis.data[0]), float(self.origin.data[1]), float(self.y_axis.data[1])

    def warnings(self, tolerance: float = 1e-9) -> list[str]:
        found = []
        if abs(self.x_axis.data[1] - self.origin.data[1]) > tolerance:
            found.append("the x axis point has another y than the origin; the origin's is used")
        if abs(self.y_axis.data[0] - self.origin.data[0]) > tolerance:
            found.append("the y axis point has another x than the origin; the origin's is used")
        return found
