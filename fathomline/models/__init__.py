"""Models behind interfaces: callers bring their own, small offline ones are trained here."""
