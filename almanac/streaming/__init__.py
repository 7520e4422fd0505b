"""See spells.py."""
