"""Where fields come from: arrays in files, NetCDF (where its libraries are installed), and synthetic waves."""

from .arrays import read_npy
from .netcdf import read_netcdf
from .synthetic import synthetic_array, synthetic_wave

__all__ = ["read_netcdf", "read_npy", "synthetic_array", "synthetic_wave"]
