"""Binding SQL bodies to a catalog: what they read, write and call, and which column comes from which.

``tokens`` and ``parser`` read statements of several dialects without a database, ``binder`` resolves names against a catalog that may be
incomplete, ``procedural`` takes routine bodies apart, ``constants`` evaluates constant text. ``enrich`` runs it all on the executors.
"""
