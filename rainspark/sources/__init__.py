"""Reading, writing and shaping of station and raster tables."""
