"""Document tables on Spark: layout, grids, cells, pages, batches and streams as DataFrames."""
