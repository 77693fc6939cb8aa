"""Spark operators for dictated-prescription transcripts, their streams and their drug catalogue."""
