"""Relational operators over quads, profiles, links and clusters."""
