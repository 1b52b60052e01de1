"""Runnable jobs over tables of files; each has a command line, a configuration file and a registered query."""
