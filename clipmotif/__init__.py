"""RNA motif analytics on Spark: sequence, structure and cross-link data as keyed DataFrames."""
