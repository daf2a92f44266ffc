"""Reports: one function per table a page shows, DataFrames in and out."""
