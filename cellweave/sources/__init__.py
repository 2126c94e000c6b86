"""Reading and writing rasters, lookup tables and vector layers; windows and resampling."""
