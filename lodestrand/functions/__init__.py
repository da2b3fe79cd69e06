"""Part of lodestrand."""
