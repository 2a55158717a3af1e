"""Class-comparison features for labelled time series, as Spark batch jobs."""
