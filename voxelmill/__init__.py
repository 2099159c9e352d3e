"""voxelmill: array-valued measurement data (views, projections, volumes) on Spark DataFrames."""

__version__ = "0.1.0"
