"""foldmark: Spark jobs for splitting, featurising, scoring and ranking tabular benchmarks."""

__version__ = "0.1.0"
