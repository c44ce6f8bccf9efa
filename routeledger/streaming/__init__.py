"""Rolling windows and runs that close by watermark."""
