"""gridloom: analytics for spatio-temporal point data on Spark DataFrames."""
