"""Readers and writers for the file kinds fine-mapping work uses."""
