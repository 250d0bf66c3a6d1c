"""Reading and writing keyed tables as text, CSV and Parquet."""
