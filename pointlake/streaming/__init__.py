"""Nothing here: the domain has no event streams. Operators that aggregate (cells.voxel_mean, cells.summary) accept
streaming DataFrames as Spark does."""
