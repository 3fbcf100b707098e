"""Registered queries over the driver tables, with equivalent SQL."""
