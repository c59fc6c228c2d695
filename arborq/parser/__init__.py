"""A parser for a subset of Julia: enough for declarations, imports, includes, calls, test items and the structural rules."""
