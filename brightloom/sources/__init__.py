"""Landing of raw pages and shaping of exports."""
