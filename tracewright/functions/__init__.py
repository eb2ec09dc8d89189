"""Column builders and plain text helpers."""
