"""gridloom: raster terrain and hydrology analytics expressed as Spark DataFrames."""
