"""Narrative analytics on Spark: sections, name candidates, co-occurrence, coreference, relations."""
