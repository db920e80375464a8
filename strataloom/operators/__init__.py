"""Operators: layout, sections, topic planning, emission, evaluation and run analytics as DataFrame functions."""
