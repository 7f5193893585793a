"""See the package README for the operator inventory."""
