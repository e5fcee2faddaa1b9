"""Part of the sequence engine; see the modules."""
