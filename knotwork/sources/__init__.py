"""Files: CSV with a sniffed dialect, Parquet, NPY, Arrow."""
