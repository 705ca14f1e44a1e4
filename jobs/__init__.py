"""Runnable jobs over stored tables; each module has a function taking a session, and a command line."""
