"""Structure-aware profiling and lossless block compression as Spark DataFrame plans."""
