"""Markup in texts: leaf blocks, the random field that labels them, and what is made of the labels."""
