"""Part of lineloom."""
