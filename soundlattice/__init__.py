"""soundlattice: content-based similarity analytics on Spark DataFrames."""
