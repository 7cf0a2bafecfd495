"""Readers and writers: strict JSON lines, inventories, shard sets, reports."""
