"""Set-based operators: each takes DataFrames and conditions and returns a DataFrame."""
