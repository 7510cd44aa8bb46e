"""Runnable jobs: each a function that takes a session and paths, with a command line and a config file."""
