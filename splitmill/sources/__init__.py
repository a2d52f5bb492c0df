"""Readers and writers: event sources, assignments, audiences, corpus, sinks, metric catalog."""
