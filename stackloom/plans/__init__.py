"""Session helpers shared by the plans of this library."""
