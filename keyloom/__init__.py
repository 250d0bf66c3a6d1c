"""keyloom: keyed-table analytics on Spark DataFrames."""
