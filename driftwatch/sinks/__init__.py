"""Writers for alerts and measured runs."""
