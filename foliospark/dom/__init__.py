"""Markup trees built with the standard library alone: HTML5, a CSS subset, and guarded XML."""
