"""Reading, checking, merging and writing the seven tables."""
