"""Rasters in cell form: one row a cell (x, z) and a column a channel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridMeta:
    """Size in samples and the spacing of samples in world units."""

    width: int
    height: int
    cell: float = 8.0

    @property
    def world_width(self) -> float:
        return self.cell * max(1, self.width - 1)


@dataclass(frozen=True)
class Grid:
    """A lazy raster.  Operators add columns; nothing runs until an action."""

    df: DataFrame
    meta: GridMeta

    def with_column(self, name: str, value: Column) -> "Grid":
        return replace(self, df=self.df.withColumn(name, value))

    def with_columns(self, values: dict[str, Column]) -> "Grid":
        return replace(self, df=self.df.withColumns(values))

    def same_size(self, other: "Grid") -> None:
        if (self.meta.width, self.meta.height) != (other.meta.width, other.meta.height):
            raise ValueError(f"rasters differ in size: {self.meta} and {other.meta}")

    def zip(self, other: "Grid", name: str, theirs: str = "v") -> "Grid":
        """Another raster's channel as a further column (aligned cells)."""
        self.same_size(other)
        return replace(self, df=self.df.join(other.df.select("x", "z", F.col(theirs).alias(name)), ["x", "z"]))


def blank(spark: SparkSession, meta: GridMeta, value: Column | float = 0.0) -> Grid:
    """A raster from a cell expression of ``x`` and ``z``."""
    cells = spark.range(meta.width * meta.height).select(
        (F.col("id") % meta.width).alias("x"), F.floor(F.col("id") / meta.width).alias("z")
    )
    return Grid(cells.withColumn("v", value if isinstance(value, Column) else F.lit(float(value))), meta)


def from_arrays(rows: DataFrame, key: str, values: str, scale: float = 1.0, cell: float = 8.0) -> Grid:
    """A raster whose row ``z`` is an array column; its size is read in one aggregation."""
    height, width = rows.agg(F.max(key) + 1, F.max(F.size(values))).first()
    cells = rows.select(F.col(key).cast("long").alias("z"), F.posexplode(values).alias("x", "v"))
    df = cells.select(F.col("x").cast("long").alias("x"), "z", (F.col("v").cast("double") * scale).alias("v"))
    return Grid(df, GridMeta(int(width or 0), int(height or 0), cell))


#: Cells a side of a tile; even, so that no 2 by 2 block is cut.
TILE = 256


def in_tiles(grid: Grid, reach: int, run: Callable[[Grid], Grid | DataFrame]) -> Grid | DataFrame:
    """``run`` on ``grid`` dealt in square tiles, each with the cells ``reach`` around it.

    The one shuffle of a stencil: windows along rows and columns stay inside a tile.  A cell near a border goes to
    each tile that needs it; what ``run`` makes of it there is dropped, so results do not depend on the tiles.
    """
    size = max(TILE, 4 * reach)

    def needed(at: str, n: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(at) - reach) / size))
        return F.explode(F.sequence(first.cast("long"), F.least(F.lit((n - 1) // size), F.floor((F.col(at) + reach) / size)).cast("long")))

    dealt = grid.df.withColumn("_tx", needed("x", grid.meta.width)).withColumn("_tz", needed("z", grid.meta.height)).repartition("_tx", "_tz")
    out = run(replace(grid, df=dealt))
    rows = out.df if isinstance(out, Grid) else out
    own = rows.where((F.floor(F.col("x") / size) == F.col("_tx")) & (F.floor(F.col("z") / size) == F.col("_tz"))).drop("_tx", "_tz")
    return replace(out, df=own) if isinstance(out, Grid) else own


def along_x() -> WindowSpec:
    """Cells of a tile's row, in order."""
    return Window.partitionBy("_tx", "_tz", "z").orderBy("x")


def along_z() -> WindowSpec:
    """Cells of a tile's column, in order."""
    return Window.partitionBy("_tx", "_tz", "x").orderBy("z")


def neighbour(v: Column | str, dx: int = 0, dz: int = 0) -> Column:
    """The value ``dx`` or ``dz`` cells away, held at the edge (one step only; inside ``in_tiles``)."""
    c = F.col(v) if isinstance(v, str) else v
    if dx:
        return F.coalesce(F.lead(c, dx).over(along_x()) if dx > 0 else F.lag(c, -dx).over(along_x()), c)
    return F.coalesce(F.lead(c, dz).over(along_z()) if dz > 0 else F.lag(c, -dz).over(along_z()), c)
