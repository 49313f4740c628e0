"""quire: structural processing of long documents on Spark DataFrames."""
