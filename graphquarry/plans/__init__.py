"""How plans are materialised and bounded."""
