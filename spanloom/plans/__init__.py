"""End-to-end plans and the driver's queries."""
