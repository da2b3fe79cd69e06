"""Readers and writers of the text formats of genomics, as DataFrames."""
