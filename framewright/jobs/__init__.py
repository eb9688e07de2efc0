"""Whole jobs over files: what one run of the tool set does, as one Spark job each."""
