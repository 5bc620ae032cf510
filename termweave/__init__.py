"""termweave: a PySpark-native engine for multilingual text assets.

Translation memories, glossaries, segment projects and a typed term graph are
DataFrames; every operator takes a DataFrame of queries or records and returns
a DataFrame, so Catalyst plans the whole of it.
"""
