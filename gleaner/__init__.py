"""Gleaner: conversation-trace and corpus operators as Spark DataFrame plans."""
