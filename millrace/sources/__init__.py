"""Readers and writers of the formats that the dialect's sources have."""
