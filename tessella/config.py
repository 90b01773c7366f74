"""Settings of all stages, with defaults, and their JSON form (sections of key-value pairs)."""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from tessella.functions.schedule import Schedule

METHODS = ("auto", "barnes_hut", "fft", "exact")


@dataclass(frozen=True)
class Initialization:
    smart: bool = True
    seed: int = -1


@dataclass(frozen=True)
class Affinities:
    perplexity: float = 30.0
    tolerance: float = 1e-5
    rounds: int = 50
    #: "mixed" adds a binary logarithm to natural units; "bits" converts
    units: str = "mixed"

    @property
    def neighbours(self) -> int:
        return int(3 * self.perplexity)

    @property
    def entropy(self) -> float:
        return math.log2(self.perplexity)


@dataclass(frozen=True)
class Forest:
    trees: int = 64
    spread: int = 4
    terms: int = 10
    seed: int = -1

    def leaf(self, k: int) -> int:
        """Fewest members of a leaf; never so few that a leaf holds no one but the point itself."""
        return max(2, self.spread * k // self.trees)


@dataclass(frozen=True)
class Gradient:
    iterations: int = 1000
    exaggeration: Schedule = Schedule("if(Iteration < 250, 12 - 11 / (1 + Exp(-0.05 * (Iteration - 200))), 1)")
    momentum: Schedule = Schedule("if(Iteration < 250, 0.5, 0.8)")
    rate: Schedule = Schedule("200")
    method: str = "auto"
    least_gain: float = 0.01


@dataclass(frozen=True)
class BarnesHut:
    condition: float = 0.5
    presort: bool = False


@dataclass(frozen=True)
class Interpolation:
    least_boxes: int = 50
    per_box: float = 1.0
    points: int = 3


@dataclass(frozen=True)
class Config:
    initialization: Initialization = field(default_factory=Initialization)
    affinities: Affinities = field(default_factory=Affinities)
    forest: Forest = field(default_factory=Forest)
    gradient: Gradient = field(default_factory=Gradient)
    barnes_hut: BarnesHut = field(default_factory=BarnesHut)
    interpolation: Interpolation = field(default_factory=Interpolation)


#: For each section of the JSON form: the field of ``Config`` and the names of its keys.
SECTIONS = {
    "Initialization": ("initialization", {"SmartInit": "smart", "InitialSolutionSeed": "seed"}),
    "Affinities": ("affinities", {"Perplexity": "perplexity", "EntropyTol": "tolerance", "EntropyIter": "rounds"}),
    "LSHF": ("forest", {"LSHForestTrees": "trees", "LSHTreeC": "spread", "LSHHashDims": "terms", "LSHSeed": "seed"}),
    "Gradient": (
        "gradient",
        {
            "Iterations": "iterations", "Exaggeration": "exaggeration", "Momentum": "momentum", "LearningRate": "rate",
            "RepulsionMethod": "method", "GradMinGain": "least_gain",
        },
    ),
    "BarnesHut": ("barnes_hut", {"BarnesHutCondition": "condition", "Presort": "presort"}),
    "PI": ("interpolation", {"min_num_intervals": "least_boxes", "intervals_per_integer": "per_box", "n_interpolation_points": "points"}),
}


def merged(base: Config, given: dict) -> Config:
    """``base`` with the keys of ``given``; what is not known is reported and left out."""
    for section, values in given.items():
        if section not in SECTIONS:
            warnings.warn(f"unknown section {section}", stacklevel=2)
            continue
        name, keys = SECTIONS[section]
        part = getattr(base, name)
        kinds = {f.name: type(getattr(part, f.name)) for f in fields(part)}
        new = {}
        for key, value in values.items():
            if key not in keys:
                warnings.warn(f"unknown key {section}.{key}", stacklevel=2)
            elif keys[key] == "method" and value not in METHODS:
                warnings.warn(f"unknown value {value!r} of {section}.{key}", stacklevel=2)
            else:
                kind = kinds[keys[key]]
                if kind is bool and isinstance(value, str):
                    value = value.strip().lower() == "true"
                new[keys[key]] = Schedule(str(value)) if kind is Schedule else kind(value)
        base = replace(base, **{name: replace(part, **new)})
    return base


def load_config(path: str | None) -> Config:
    """Defaults merged with a JSON file; a missing file is reported and gives the defaults."""
    if path is None or not Path(path).exists():
        if path is not None:
            warnings.warn(f"no such file: {path}; defaults are used", stacklevel=2)
        return Config()
    return merged(Config(), json.loads(Path(path).read_text()))
