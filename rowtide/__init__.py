"""Rowtide: entity-history features, scoring and sampling as Spark jobs."""
