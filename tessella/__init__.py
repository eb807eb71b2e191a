"""A batch analytics engine on Spark DataFrames: term counts, inverted indexes, joins and link analysis."""
