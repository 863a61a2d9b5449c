"""lexiframe: text-corpus and next-token dataset operators on Spark DataFrames.

Every operator is a plain function from DataFrame to DataFrame (or from Column
to Column in ``lexiframe.functions``).
"""
