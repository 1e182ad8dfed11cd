"""Document guardrails as DataFrame operators."""
