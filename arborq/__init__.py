"""arborq: a workspace-analytics engine on PySpark DataFrames."""
