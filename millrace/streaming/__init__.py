"""Streams: notifications, windows and tables that follow a stream."""
