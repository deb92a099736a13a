"""Training-data operators: formatting, filtering, de-duplication, scoring, mixing and tokenising of text corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames, reads only the columns it
names, and leaves other columns of its input alone, so extra columns never clash with what it adds.
"""
