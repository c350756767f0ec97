"""Readers and adapters that give the engine's typed tables."""
