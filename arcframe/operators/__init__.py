"""Operators on tables of entries, blocks and attributes. All are lazy DataFrame plans."""
