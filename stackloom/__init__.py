"""Trace analytics on Spark: call profiles, structural similarity of processes, concept lattices and sequence diffs."""
