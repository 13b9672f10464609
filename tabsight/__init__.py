"""tabsight: table intelligence on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame.
"""
