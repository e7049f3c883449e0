"""Readers and writers of the text and binary formats, from and to typed DataFrames."""
