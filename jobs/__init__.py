"""Runnable jobs; each has a command line and a small config file beside it."""
