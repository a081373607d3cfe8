"""Readers that check what they read, and writers that check what they wrote."""
