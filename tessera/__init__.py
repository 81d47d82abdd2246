"""Company-research analytics on Spark: operators as DataFrame-to-DataFrame functions."""
