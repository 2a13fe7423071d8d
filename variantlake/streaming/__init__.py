"""Files analysed as they arrive."""
