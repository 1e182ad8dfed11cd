"""Structured Streaming forms of the operators that need state.

The stateless operators (detector, output filter, sanitizer, validation of single documents, prompt
rendering, audit records) take streaming DataFrames as they are.
"""
