"""Operators that prepare text corpora for training language models.

Each module holds one operator: a function from DataFrames to a DataFrame with its own parameters.
``queries`` registers one query per operator, ``oracles`` the SQL that checks those SQL can express.
"""
