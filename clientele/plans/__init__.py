"""From candidates to at most one plan per customer, and the whole decision cycle."""
