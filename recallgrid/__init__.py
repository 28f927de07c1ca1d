"""recallgrid: conversational-memory analytics as Spark DataFrame operators.

Raw chat logs become turns, turns become memory notes, notes are linked and
searched, and both the search and the answers built on it are scored.  Every
operator takes DataFrames and returns a DataFrame without running an action;
only sources, sinks, streaming jobs and the plans built on them do.
"""
