"""Timed-text analytics on Spark: table operators for transcripts, translations and level series."""
