"""Readers and writers: flow events, packet summaries, feature tables, alerts."""
