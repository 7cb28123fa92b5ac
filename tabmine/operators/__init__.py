"""Operators on labelled tables: profiling, preparation, selection, models, evaluation."""
