"""Corpusloom: a document-corpus analytics engine on PySpark DataFrames."""
