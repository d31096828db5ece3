"""How runs are planned, audited and recovered."""
