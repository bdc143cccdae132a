"""Multi-operator plans: reading feeds end to end, per-item programs, output."""
