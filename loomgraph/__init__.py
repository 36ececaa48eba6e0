"""Property-graph analytics over markdown, source code and facts, as Spark DataFrame programs."""
