"""Readers and writers: transactions, feeds, decision log, scored tables, model bundles."""
