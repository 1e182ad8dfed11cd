"""The screening paths put together from the operators."""
