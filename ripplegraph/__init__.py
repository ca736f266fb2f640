"""Change-impact analytics over typed dependency graphs, expressed as Spark plans."""
