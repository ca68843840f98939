"""The dialect: syntax, verification, lowering to DataFrames, estimates, and the query catalogue."""
