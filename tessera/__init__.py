"""tessera: document analytics on PySpark DataFrames."""
