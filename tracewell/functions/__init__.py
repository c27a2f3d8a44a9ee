"""Column functions: signal scalars, frequency grids, hash-keyed randomness."""

from tracewell.functions.grids import band_windows, eq3_grid, linear_grid
from tracewell.functions.randoms import hash_normal, hash_uniform
from tracewell.functions.signal import active_flag, clip, fmax_mhz, from_db, l2_norm, l2_normalize, magnitude, shunt_voltage, to_bin, to_db

__all__ = ["active_flag", "band_windows", "clip", "eq3_grid", "fmax_mhz", "from_db", "hash_normal", "hash_uniform", "l2_norm", "l2_normalize", "linear_grid", "magnitude", "shunt_voltage", "to_bin", "to_db"]
