"""blockml: array analytics and machine learning on plain PySpark DataFrames."""
