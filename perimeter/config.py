"""Settings of a study, with the defaults every operator falls back to."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------------
SPLIT_YEARS = {"train": (2015, 2020), "val": (2021, 2021), "test": (2022, 2023)}
THRESHOLDS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98)
RINGS = (1, 3, 5, 8)
BAND_EDGES = (1, 2, 3, 5, 8, 12, 20, 32)
RELIABILITY_EDGES = (0, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)
FIRE_SEASON = (6, 10)
FUEL_RANGES = ((91, 93), (98, 99), (101, 109), (121, 124), (141, 149), (161, 165), (181, 189), (201, 204))
FUEL_CODES = tuple(code for low, high in FUEL_RANGES for code in range(low, high + 1))
FUEL_GROUPS = (
    ("non-burnable", 91, 99),
    ("grass", 101, 109),
    ("grass-shrub", 121, 129),
    ("shrub", 141, 149),
    ("timber-understory", 161, 169),
    ("timber-litter", 181, 189),
    ("slash", 201, 209),
)
WIND = ("u10_lag0", "u10_lag6", "u10_lag12", "v10_lag0", "v10_lag6", "v10_lag12")
WEATHER = WIND + ("rh2m", "t2m", "fosberg_10h")
STATIC = ("elevation", "slope", "aspect_sin", "aspect_cos", "tpi", "cc", "ch")
CHANNELS = ("burn_mask",) + WEATHER + ("elevation_centred",) + STATIC[1:]
DIRECTION_GROUPS = (WIND, ("aspect_sin", "aspect_cos"))
EAST_CHANNELS = ("u10_lag0", "u10_lag6", "u10_lag12", "aspect_sin")
NORTH_CHANNELS = ("v10_lag0", "v10_lag6", "v10_lag12", "aspect_cos")
CHANNEL_GROUPS = {
    "wind": WIND,
    "moisture": ("rh2m", "fosberg_10h"),
    "temperature": ("t2m",),
    "terrain": ("elevation_centred", "slope", "aspect_sin", "aspect_cos", "tpi"),
    "canopy": ("cc", "ch"),
    "burn mask": ("burn_mask",),
    "downwind": ("downwind",),
}
WANTED_MESSAGES = (("UGRD", "10 m above ground"), ("VGRD", "10 m above ground"),
                   ("TMP", "2 m above ground"), ("RH", "2 m above ground"), ("DPT", "2 m above ground"))
# ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    min_confidence: str = "n"
    vegetation_only: bool = True
    link_km: float = 2.0
    link_hours: int = 96
    min_detections: int = 25
    min_timesteps: int = 3
    window_hours: int = 24
    gap_flag_hours: int = 48
    no_data_windows: tuple[tuple[str, str], ...] = ()
    resolution_m: int = 100
    patch: int = 256
    stride: int = 128
    dilate_radius: int = 2
    close_radius: int = 4
    t_steps: int = 3
    horizon_hours: int = 24
    lags: tuple[int, ...] = (0, 6, 12)
    max_reach: int = 3
    repair_rounds: int = 2
    weather_start: str = "2014-07-30"
    weather_margin_km: float = 20.0
    min_coverage: float = 0.98
    tpi_radius_m: float = 300.0
    elevation_mode: str = "fire_centred"
    burn_mode: str = "cumulative"
    downwind: bool = False
    split_years: dict = field(default_factory=lambda: dict(SPLIT_YEARS))

    def __post_init__(self) -> None:
        if self.horizon_hours != self.window_hours:
            raise ValueError("the prediction horizon must equal the label window")
        if self.elevation_mode not in ("fire_centred", "raw", "none"):
            raise ValueError(f"unknown elevation_mode {self.elevation_mode!r}")
        if self.burn_mode not in ("cumulative", "incremental"):
            raise ValueError(f"unknown burn_mode {self.burn_mode!r}")
        if self.grid_margin_m <= self.resolution_m * (self.dilate_radius + 2 * self.close_radius):
            raise ValueError("the grid margin is too small for border-free morphology")

    @property
    def grid_margin_m(self) -> float:
        """Margin around the detections: half a tile plus two kilometres."""
        return self.patch * self.resolution_m / 2 + 2000

    @property
    def channels(self) -> tuple[str, ...]:
        names = CHANNELS
        if self.downwind:
            after = 1 + len(WEATHER)
            names = names[:after] + ("downwind",) + names[after:]
        if self.elevation_mode == "none":
            names = tuple(c for c in names if c != "elevation_centred")
        return names


# The driver tables cover footprints of about 12 km x 8 km, so small tiles make tiling meaningful.
FIXTURE = Settings(patch=32, stride=16, weather_margin_km=6.0,
                   no_data_windows=(("2021-01-20", "2021-01-21"), ("2016-01-05", "2016-01-06")))
