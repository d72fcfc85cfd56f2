"""Tallyloom: labelled event-log analytics and multiclass model selection on Spark."""
