"""What a field codec is bound to: shape, error bound, missing sentinel, dtype. Checked before any plan is built."""

from __future__ import annotations

import math
import numbers
from dataclasses import dataclass, field

import numpy as np

CODEC_ID = "fieldpress"
DTYPES = ("float32", "float64")


class ConfigError(ValueError):
    pass


def check_bound(value) -> float:
    """A finite number >= 0. Booleans and other types are TypeErrors."""
    if isinstance(value, (bool, np.bool_)) or not isinstance(value, numbers.Real):
        raise TypeError(f"error bound must be a number, not {type(value).__name__}")
    value = float(value)
    if not math.isfinite(value) or value < 0:
        raise ValueError("error bound must be finite and not negative")
    return value


def check_missing(value) -> float:
    """``"nan"`` in any case, or a finite number; NaN stands for "nan"."""
    if isinstance(value, str):
        if value.lower() != "nan":
            raise ValueError(f"unknown missing value {value!r}")
        return math.nan
    if isinstance(value, bool) or not isinstance(value, numbers.Real):
        raise TypeError("missing value must be a number or 'nan'")
    if math.isinf(value):
        raise ValueError("missing value can't be infinite")
    return float(value)


def check_shape(shape) -> tuple[int, int, int]:
    """(time, lat, lon); two numbers are one time step."""
    dims = tuple(shape)
    if len(dims) not in (2, 3):
        raise ValueError("a field has two or three dimensions")
    for n in dims:
        if isinstance(n, bool) or not isinstance(n, (int, np.integer)) or n <= 0:
            raise ValueError(f"dimension {n!r} isn't a positive integer")
    return tuple(map(int, dims if len(dims) == 3 else (1, *dims)))


@dataclass(frozen=True)
class FieldConfig:
    shape: tuple[int, ...]
    error_bound: float
    missing_value: float | str = math.nan
    dtype: str = "float32"
    outer_compress: bool = True
    codec_id: str = field(default=CODEC_ID, repr=False)

    def __post_init__(self):
        for name, value in (("shape", check_shape(self.shape)), ("error_bound", check_bound(self.error_bound)), ("missing_value", check_missing(self.missing_value)), ("dtype", np.dtype(self.dtype).name)):
            object.__setattr__(self, name, value)
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype must be one of {DTYPES}")

    @property
    def np_dtype(self) -> np.dtype:
        return np.dtype(self.dtype)

    @property
    def effective_bound(self) -> float:
        return max(self.error_bound, float(np.finfo(self.np_dtype).eps))

    @property
    def step(self) -> float:
        return derive_step(self.error_bound, self.dtype)

    def get_config(self) -> dict:
        missing = "nan" if math.isnan(self.missing_value) else self.missing_value
        return {"id": self.codec_id, "shape": list(self.shape), "error_bound": self.error_bound, "missing_value": missing, "dtype": self.dtype, "outer_compress": self.outer_compress}

    @classmethod
    def from_config(cls, config: dict) -> FieldConfig:
        rest = dict(config)
        if (found := rest.pop("id", None)) != CODEC_ID:
            raise ValueError(f"codec id is {found!r}, not {CODEC_ID!r}")
        if lacking := {"shape", "error_bound"} - rest.keys():
            raise ValueError(f"config lacks {sorted(lacking)}")
        return cls(**rest)


def derive_step(bound: float, dtype: str = "float32") -> float:
    """Width of a quantization cell: twice the bound, of which the dtype's epsilon is the floor."""
    return 2.0 * max(check_bound(bound), float(np.finfo(np.dtype(dtype)).eps))
