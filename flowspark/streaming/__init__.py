"""Cleaning and counting of reads as they arrive. An extension: the batch operators' expressions on streams."""
