"""Operators for preparing training corpora (documents, embeddings, labels).

Every operator is a plain function from DataFrames to a DataFrame.  ``registry``
binds them to the tables of a data folder; nothing else in the library imports
this subpackage.
"""
