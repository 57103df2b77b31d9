"""Readers, writers and maintenance of the partitioned quad table and of link tables."""
