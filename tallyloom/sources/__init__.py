"""Readers and writers: log tables, feature matrices, metric and model stores."""
