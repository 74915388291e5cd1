"""Feature, scoring, sampling and ensemble operators on DataFrames."""
