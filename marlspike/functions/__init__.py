"""Part of marlspike; see the README."""
