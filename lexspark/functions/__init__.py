"""Part of lexspark."""
