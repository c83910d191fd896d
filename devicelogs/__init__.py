"""DataFrame jobs over device logs: one independent stream per (device, boot)."""
