"""The library's operators applied to the given tables, each with an equivalent SQL text."""
