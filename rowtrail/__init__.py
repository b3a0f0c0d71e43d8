"""Row-level provenance and fault isolation for PySpark DataFrames."""
