"""Scenes and pixels as relations."""
