"""Training-data operators: mixing, filtering, de-duplication, scoring, packing and sharding of text.

Every operator is a function from DataFrames to a DataFrame. The rest of the library does not import this package.
"""
