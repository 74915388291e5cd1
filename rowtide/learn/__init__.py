"""Models whose training is Spark jobs over a binned matrix."""
