"""All tunables of the detection pipeline, with their defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, field, make_dataclass

#: Section, key and default of each tunable.
SETTINGS = (
    ("detrend", "window_days", 8.1871),
    ("detrend", "polyorder", 2),
    ("detrend", "upper_sigma_clip", 5.0),
    ("detrend", "spline_knot_spacing_days", 1.5),
    ("baseline", "median_window_days", 2.0621),
    ("baseline", "noise_window_days", 2.0621),
    ("candidates", "sigma_threshold", 4.0),
    ("candidates", "min_consecutive", 3),
    ("candidates", "max_gap_cadences", 2),
    ("candidates", "max_window_days", 3.0),
    ("candidates", "recovery_sigma", 1.0),
    ("candidates", "edge_margin_days", 1.0208),
    ("asymmetry", "half_depth_fraction", 0.5),
    ("asymmetry", "min_points_per_side", 3),
    ("asymmetry", "search_padding_factor", 2.0),
    ("scoring", "bootstrap_draws", 1000),
    ("scoring", "delta_bic_threshold", 10.0),
    ("scoring", "tau_over_sigma_threshold", 1.0),
    ("scoring", "periodicity_min_period_days", 0.5),
    ("scoring", "periodicity_max_period_days", 50.0),
    ("scoring", "periodicity_fap_threshold", 0.01),
    ("runtime", "rng_seed", 42),
)


def _section(name: str) -> type:
    return make_dataclass(name.capitalize(), [(key, type(value), value) for section, key, value in SETTINGS if section == name], frozen=True, module=__name__)


Detrend, Baseline, Candidates, Asymmetry, Scoring, Runtime = map(_section, ("detrend", "baseline", "candidates", "asymmetry", "scoring", "runtime"))
SECTIONS = {kind.__name__.lower(): kind for kind in (Detrend, Baseline, Candidates, Asymmetry, Scoring, Runtime)}
#: One attribute for each section, each with one for each key; asdict() gives nested mappings.
Config = make_dataclass("Config", [(name, kind, field(default_factory=kind)) for name, kind in SECTIONS.items()], frozen=True, module=__name__, namespace={"to_dict": asdict})


def from_dict(values: Mapping) -> Config:
    """A Config from nested mappings. ValueError for what is no tunable, TypeError for a section that is no mapping."""
    flat = [(section, key) for section, given in values.items() if isinstance(given, Mapping) for key in given]
    if strange := sorted({*flat} - {(section, key) for section, key, _ in SETTINGS}) or sorted(values.keys() - SECTIONS.keys()):
        raise ValueError(f"no such tunables: {strange}")
    if flat_sections := [section for section, given in values.items() if not isinstance(given, Mapping)]:
        raise TypeError(f"no mappings: {flat_sections}")
    return Config(**{section: SECTIONS[section](**given) for section, given in values.items()})
