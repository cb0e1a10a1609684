"""Reading and writing tables: delimited text, Parquet, workbooks."""
