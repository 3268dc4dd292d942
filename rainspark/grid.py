"""North-up raster geometry and the fixed vocabulary of the IDF domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Fixed values -----------------------------------------------------------------------------
DURATIONS_MIN = (5, 10, 15, 20, 25, 30, 60, 360, 480, 600, 720, 1440)
RETURN_PERIODS = (2, 5, 10, 25, 50, 75, 100)
CETESB_FACTORS = (0.12, 0.191, 0.248, 0.287, 0.322, 0.354, 0.479, 0.821, 0.889, 0.935, 0.969, 1.14)
CURVE_DURATIONS_MIN = (5, 10, 15, 20, 25, 30, 60, 120, 240)
CURVE_RETURN_PERIODS = (2, 5, 10, 25, 50, 100)
DESIGN_POINTS = ((10, 10), (100, 60))  # (return period in years, duration in minutes)
PARAMETER_BANDS = (
    "K", "a", "b", "c", "R2", "RMSE", "MSE", "KS_D", "KS_p", "KS_reject",
    "AMD_mean", "AMD_std", "Nyears",
)
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grid:
    """Cell (row, col) covers x0+col*dx .. x0+(col+1)*dx and y0-row*dy .. y0-(row+1)*dy.

    `nrows`/`ncols` may be None for a grid that is open to the south/east.
    """

    x0: float
    y0: float
    dx: float
    dy: float
    nrows: int | None = None
    ncols: int | None = None

    def row_of(self, lat: Column) -> Column:
        return F.floor((F.lit(self.y0) - lat) / F.lit(self.dy)).cast("int")

    def col_of(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.x0)) / F.lit(self.dx)).cast("int")

    def lat_of(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + F.lit(0.5)) * F.lit(self.dy)

    def lon_of(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.dx)

    def inside(self, row: Column, col: Column) -> Column:
        ok = (row >= 0) & (col >= 0)
        if self.nrows is not None:
            ok = ok & (row < self.nrows)
        if self.ncols is not None:
            ok = ok & (col < self.ncols)
        return ok

    def same_as(self, other: Grid, tol: float = 1e-9) -> bool:
        def close(p: float, q: float) -> bool:
            return abs(p - q) <= tol * max(1.0, abs(q))

        return (
            (self.nrows, self.ncols) == (other.nrows, other.ncols)
            and close(self.x0, other.x0) and close(self.y0, other.y0)
            and close(self.dx, other.dx) and close(self.dy, other.dy)
        )
