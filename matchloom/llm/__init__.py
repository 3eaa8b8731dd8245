"""Operators for text and preference data. Nothing else in matchloom imports this subpackage."""
