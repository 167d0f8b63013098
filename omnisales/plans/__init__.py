"""The sales view and the analyses built on it."""
