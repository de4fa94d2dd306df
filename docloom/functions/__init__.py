"""Values, codecs and expressions."""
