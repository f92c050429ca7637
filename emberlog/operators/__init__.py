"""Log operators expressed as DataFrame plans."""
