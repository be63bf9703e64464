"""Readers and writers for the TSV / CSV / line formats of the corpus."""
