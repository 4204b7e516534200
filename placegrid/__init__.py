"""placegrid: reusable Spark operators for place-level planning data.

DataFrame in, DataFrame out. Everything stays in built-in column expressions, so Catalyst plans, prunes and
generates code for it; there is no Python UDF in the package.
"""
