"""Extension: the reference semantics are batch only; these run them on arriving frames."""
